"""The jobs as queries: each runs twice into a new folder, and its output is read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from clauseforge.operators import index as I
from clauseforge.plans import sql as S
from clauseforge.plans.answering import SIGNALS
from clauseforge.plans.registry import query
from clauseforge.session import shared_folder
from jobs import answer_report, index_feed


def folder(spark, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query(
    "job1_index_feed",
    f"""WITH {S.POSTINGS} SELECT 'document' AS kind, spec_id, clause, pos, NULL AS term, dl AS n FROM dls JOIN chunks USING (pos)
UNION ALL SELECT 'posting', NULL, NULL, pos, term, tf FROM posts UNION ALL SELECT 'term', NULL, NULL, NULL, term, df FROM terms""",
)
def job1_index_feed(spark, sf_dir):
    """All three parts of the index: documents with their lengths, postings, and document frequencies."""
    place = folder(spark, "index-feed")
    config = index_feed.Config(f"{sf_dir}/documents.parquet", f"{place}/index", f"{place}/checkpoint", files_per_batch=100, buckets=8, spread=4)
    for _ in range(2):
        index_feed.run(spark, config)
    held = index_feed.tables(spark, config.out)
    none = lambda kind: F.lit(None).cast(kind)
    lengths = index_feed.live(spark, config.out).where(F.col("term") == I.MARK).select("pos", "dl")
    d = held["chunks"].join(lengths, "pos").select(F.lit("document").alias("kind"), "spec_id", "clause", "pos", none("string").alias("term"), F.col("dl").alias("n"))
    p = held["postings"].select(F.lit("posting").alias("kind"), none("string").alias("spec_id"), none("string").alias("clause"), "pos", "term", F.col("tf").alias("n"))
    t = held["terms"].select(F.lit("term").alias("kind"), none("string").alias("spec_id"), none("string").alias("clause"), none("long").alias("pos"), "term", F.col("df").alias("n"))
    return d.unionByName(p).unionByName(t)


@query(
    "job2_answer_report",
    f"""WITH {S.HITS}, {SIGNALS}, gates AS (SELECT qid, CASE WHEN hits = 0 THEN 'retrieval' WHEN top < 0.20 THEN 'best' WHEN overlap < 0.08 THEN 'the' WHEN support < 0.18 AND top < 0.32 THEN 'one' ELSE 'sufficient' END AS rule, 0.60 * top + 0.25 * support + 0.15 * overlap AS confidence FROM sig)
SELECT g.qid, rule = 'sufficient' AS answerable, rule, round(round(confidence, 4), 3) AS confidence, rank, pos, spec_id, clause, round(score, 6) AS score, round(h.overlap, 6) AS overlap, spec_id || ' v1, clause ' || clause AS citation FROM gates g LEFT JOIN hits h USING (qid)""",
)
def job2_answer_report(spark, sf_dir):
    config = answer_report.Config(f"{sf_dir}/documents.parquet", f"{sf_dir}/benchmark.parquet", folder(spark, "answer-report"))
    for _ in range(2):
        answer_report.run(spark, config)
    return answer_report.written(spark, config.out)
