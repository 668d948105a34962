"""Reports for a set of questions which of them the corpus can answer, and from which passages.

The whole set is retrieved at once (BM25 and TF-IDF lists, fused, boosted, reranked and
diversified), the gate decides for each question by its first rule that refuses, and the
passages go with their citation into a table partitioned by ``answerable``. A set of questions that is
reported after every change of the corpus shows what the change made answerable.

With ``index`` (the output of jobs.index_feed) nothing is tokenised but the questions; without, the
documents are tokenised once. A run replaces the whole report, so running it again gives the same rows.

Edge cases: a question without a hit has one row without a passage; rows without an id are left
out; null texts count as empty; of repeated ids of questions the greatest text counts, of those of
documents the one with the greatest digest; other columns are not looked at.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clauseforge.functions import text as T
from clauseforge.operators import answers as A
from clauseforge.operators import index as I
from clauseforge.operators import retrieval as R
from clauseforge.session import settled
from jobs import index_feed
from jobs.settings import cluster_session, command, log

SCHEMA = "qid long, rule string, confidence double, rank long, pos long, spec_id string, clause string, score double, overlap double, citation string, answerable boolean"


@dataclass(frozen=True)
class Config:
    documents: str = ""
    questions: str = ""
    out: str = ""
    index: str = ""
    candidates: int = 50
    depth: int = 20
    hits: int = 6
    per_clause: int = 2


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    q = spark.read.parquet(path).where("item_id is not null")
    return q.groupBy(F.col("item_id").alias("qid")).agg(F.max(F.coalesce("text", F.lit(""))).alias("question"))


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Documents as chunks in the form that the index has them in."""
    rows = index_feed.incoming(spark.read.parquet(path))
    return rows.select("pos", "spec_id", "clause", index_feed.path_and_text().alias("indexed"), F.lit(1).alias("parts"))


def report(spark: SparkSession, config: Config) -> DataFrame:
    """(qid, answerable, rule, confidence, rank, pos, spec_id, clause, score, overlap, citation)."""
    questions = read_questions(spark, config.questions)
    held = index_feed.tables(spark, config.index) if config.index else I.tables(read_chunks(spark, config.documents))
    found = R.retrieve(held["chunks"], questions, held["terms"], candidates=config.candidates, depth=config.depth, k=config.hits, cap=config.per_clause, tables=held)
    hits = settled(found)  # a few rows a question, read twice
    gates = A.gate(A.signals(questions, hits))
    cite = T.citation("", F.col("spec_id"), F.lit("1"), F.col("clause"), F.lit(""))
    passages = hits.select("qid", "rank", "pos", "spec_id", "clause", F.round("score", 6).alias("score"), F.round("overlap", 6).alias("overlap"), F.trim(cite).alias("citation"))
    rule = F.substring_index("reason", " ", 1)
    decided = gates.select("qid", "answerable", rule.alias("rule"), F.round("confidence", 3).alias("confidence"))
    return decided.join(passages, "qid", "left")


def written(spark: SparkSession, out: str) -> DataFrame:
    """The report that a run has left."""
    return spark.read.schema(SCHEMA).parquet(out)


def run(spark: SparkSession, config: Config) -> dict[str, int]:
    """Writes the report and returns the number of questions by rule."""
    rows = report(spark, config)
    rows.repartition("answerable", F.pmod(F.xxhash64("qid"), F.lit(16))).sortWithinPartitions("qid", "rank").write.mode("overwrite").partitionBy("answerable").parquet(config.out)
    left = written(spark, config.out)
    by_rule = {r["rule"]: r["n"] for r in left.groupBy("rule").agg(F.count_distinct("qid").alias("n")).collect()}  # a handful of rules
    log.info("read %d questions of %s over %s", sum(by_rule.values()), config.questions, config.index or config.documents)
    log.info("wrote %s: %d rows; questions by rule: %s", config.out, left.count(), by_rule)
    return by_rule


def main(argv: list[str] | None = None) -> int:
    config = command(Config, argv, __doc__.split("\n")[0])
    spark = cluster_session("answer_report")
    try:
        run(spark, config)
    finally:
        spark.stop()
    return 0


if __name__ == "__main__":
    sys.exit(main())
