"""The corpus pipeline: documents in, packed token sequences out.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and returns what
it keeps; all but the last return the columns of documents. Rejected documents, copies but one of
each group, and documents that hold a benchmark passage go; failing lines are taken out of the
text and secrets are replaced by their kind.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clauseforge.llm import common, decontaminate, near_copies, packing, quality, queries, secrets
from clauseforge.session import remove

#: Iterative and vocabulary-based stages have no SQL; tests hold the pipeline against a plain version.
ORACLE_SQL = None


def _sized(docs: DataFrame) -> DataFrame:
    """n_chars follows the text, where there is such a column."""
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _sized(quality.clean(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_copies.deduplicated(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _sized(secrets.redact(docs, path=secrets.ledger_folder(spark)))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, queries.vocabulary())


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("benchmark_leaks", benchmark_leaks),
    ("secret_scans", secret_scans),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written to the shared folder and read again.

    A result goes once the next one is written, and a stage's checkpoints once its own is. The last result
    and the tables of packing, which the returned rows are read from, stay.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    place = f"{common.shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        if k + 1 == len(STAGES):
            return stage(spark, docs, sf_dir)
        with common.passing(spark):
            stage(spark, docs, sf_dir).write.parquet(f"{place}/{k}")
        if k:
            remove(spark, f"{place}/{k - 1}")
        docs = spark.read.parquet(f"{place}/{k}")
