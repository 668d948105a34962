"""What the jobs share: a config file of known keys, a logger, tables that may not be there yet."""

from __future__ import annotations

import argparse
import json
import logging
from dataclasses import fields, replace

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

log = logging.getLogger("clauseforge.jobs")


def from_file(kind, path: str, overrides: dict):
    """A dataclass of settings from a JSON file and what the command line sets; unknown keys are refused."""
    with open(path, encoding="utf-8") as f:
        given = json.load(f)
    known = {f.name for f in fields(kind)}
    if unknown := set(given) - known:
        raise ValueError(f"{path}: unknown settings {', '.join(sorted(unknown))}")
    return replace(kind(**given), **{k: v for k, v in overrides.items() if v is not None})


def command(kind, argv: list[str] | None, doc: str):
    """Settings of a command line: a config file, and an option for each of its keys."""
    parser = argparse.ArgumentParser(description=doc)
    parser.add_argument("config", help="JSON file of settings")
    for f in fields(kind):
        parser.add_argument("--" + f.name.replace("_", "-"), type=type(f.default) if f.default is not None and not isinstance(f.default, type) and f.default != "" else str)
    args = vars(parser.parse_args(argv))
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(levelname)s %(message)s")
    return from_file(kind, args.pop("config"), args)


def cluster_session(name: str) -> SparkSession:
    """The session of a command line: master and cluster settings come from spark-submit or the defaults file."""
    return SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").getOrCreate()


def stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table that a job has written, without rows before its first run."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
