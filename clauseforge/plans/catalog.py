"""Imports every module that registers queries."""

from clauseforge.plans import answering, jobs, search, structure  # noqa: F401
from clauseforge.plans.registry import ORACLES, QUERIES  # noqa: F401
