"""Settings of a retrieval engine, from the environment or as given."""

from __future__ import annotations

import os
from dataclasses import dataclass, field
from pathlib import Path


def text(name: str, default: str) -> str:
    return os.environ.get(name) or default


def number(name: str, default, kind=float):
    """The variable as a number; unset, empty or malformed ones give the default."""
    try:
        return kind(os.environ.get(name) or default)
    except ValueError:
        return default


def load_env(path: str | Path) -> None:
    """KEY=VALUE lines of a file into the environment; variables that are set stay."""
    path = Path(path)
    if not path.exists():
        return
    for line in path.read_text(encoding="utf-8").splitlines():
        key, equals, value = line.partition("=")
        if equals and key.strip() and not key.lstrip().startswith("#"):
            os.environ.setdefault(key.strip(), value.strip().strip("'\""))


@dataclass(frozen=True)
class Retrieval:
    candidates: int = 50
    rrf_k: int = 60
    depth: int = 20
    final_k: int = 6
    window: int = 1
    parts_per_clause: int = 2
    reranker: str = "lexical"


@dataclass(frozen=True)
class Guard:
    min_top: float = 0.20
    min_support: float = 0.18
    min_overlap: float = 0.08
    min_claim_support: float = 0.45
    drop_unverified: bool = True
    premise_check: bool = True


@dataclass(frozen=True)
class Chunking:
    target: int = 320
    limit: int = 480
    overlap: int = 48


@dataclass(frozen=True)
class Settings:
    index_dir: str = "index"
    embeddings: str = "latent"
    latent_dims: int = 256
    llm: str = "none"
    retrieval: Retrieval = field(default_factory=Retrieval)
    guard: Guard = field(default_factory=Guard)
    chunking: Chunking = field(default_factory=Chunking)

    @classmethod
    def from_env(cls, prefix: str = "CLAUSEFORGE_") -> "Settings":
        return cls(
            index_dir=text(prefix + "INDEX_DIR", "index"),
            embeddings=text(prefix + "EMBEDDINGS", "latent"),
            latent_dims=number(prefix + "LATENT_DIMS", 256, int),
            llm=text(prefix + "LLM", "none"),
            retrieval=Retrieval(final_k=number(prefix + "K", 6, int), rrf_k=number(prefix + "RRF_K", 60, int), reranker=text(prefix + "RERANKER", "lexical")),
            guard=Guard(min_top=number(prefix + "MIN_TOP", 0.20), min_support=number(prefix + "MIN_SUPPORT", 0.18), min_overlap=number(prefix + "MIN_OVERLAP", 0.08)),
        )
