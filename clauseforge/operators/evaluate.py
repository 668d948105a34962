"""Retrieval and decision metrics over a golden set, as aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clauseforge.functions import text as T


def truth(golden: DataFrame) -> DataFrame:
    """(qid, spec_id, clause) expected of the answerable questions that name any; null accepts all."""
    any_of = lambda c: F.when(F.size(c) > 0, F.col(c)).otherwise(F.array(F.lit(None).cast("string")))
    named = golden.where(F.col("expect_answerable") & ((F.size("expect_specs") > 0) | (F.size("expect_clauses") > 0)))
    return named.select("qid", F.explode(any_of("expect_specs")).alias("spec_id"), any_of("expect_clauses").alias("c")).select("qid", "spec_id", F.explode("c").alias("clause"))


def rank_of(hits: DataFrame, expected: DataFrame) -> DataFrame:
    """(qid, hit_rank): the first hit of an expected specification and clause; null if none.

    ``expected`` (qid, spec_id, clause): a null clause accepts any, a null specification too.
    """
    e = expected.select("qid", F.col("spec_id").alias("_spec"), F.col("clause").alias("_clause"))
    rows = hits.join(e, "qid").where((F.col("_spec").isNull() | (F.col("_spec") == F.col("spec_id"))) & (F.col("_clause").isNull() | T.clause_matches("clause", "_clause")))
    first = rows.groupBy("qid").agg(F.min("rank").alias("hit_rank"))
    return expected.select("qid").distinct().join(first, "qid", "left")


def retrieval_metrics(ranks: DataFrame, by: str = "mode") -> DataFrame:
    """(mode, questions, recall, mrr, top1, median_rank) of rows (mode, qid, hit_rank)."""
    n = F.count("*")
    return ranks.groupBy(by).agg(
        n.alias("questions"),
        F.round(F.count("hit_rank") / n, 4).alias("recall"),
        F.round(F.coalesce(F.sum(1 / F.col("hit_rank")), F.lit(0.0)) / n, 4).alias("mrr"),
        F.round(F.count(F.when(F.col("hit_rank") == 1, 1)) / n, 4).alias("top1"),
        F.percentile("hit_rank", F.lit(0.5)).alias("median_rank"),
    )


def item_checks(answers: DataFrame, golden: DataFrame) -> DataFrame:
    """Answers (qid, answer, abstained, offered, cited) against golden rows: what is missing, forbidden, miscited, and the decision."""
    rows = answers.join(golden, "qid")
    body = F.lower("answer")
    missing = F.when(F.col("abstained"), F.array().cast("array<string>")).otherwise(F.filter("must_include", lambda t: ~body.contains(F.lower(t))))
    forbidden = F.filter("must_not_include", lambda t: body.contains(F.lower(t)))
    valid = F.forall("cited", lambda n: n.between(1, F.col("offered")))
    return rows.select("qid", "expect_answerable", "abstained", (F.col("abstained") != F.col("expect_answerable")).alias("correct_decision"), missing.alias("missing_required"), forbidden.alias("forbidden_present"), valid.alias("citations_valid"))


def summary(items: DataFrame) -> DataFrame:
    """One row of metrics over items (expect_answerable, abstained, correct_decision, groundedness, claims, dropped, hit_rank, has_truth)."""
    yes, no = F.col("expect_answerable"), ~F.col("expect_answerable")
    answered = yes & ~F.col("abstained")
    number = lambda c: F.count(F.when(c, 1))
    share = lambda a, b, none=None: F.round(F.when(number(b) > 0, number(a & b) / number(b)).otherwise(F.lit(none).cast("double")), 4)
    truth = yes & F.col("has_truth")
    return items.agg(
        F.count("*").alias("questions"),
        number(yes).alias("answerable"),
        number(no).alias("adversarial"),
        share(~F.col("abstained"), yes, 0.0).alias("answer_rate"),
        share(F.col("abstained"), no).alias("correct_abstention_rate"),
        number(no & ~F.col("abstained")).alias("false_answers"),
        share(F.col("hit_rank").isNotNull(), truth).alias("retrieval_recall"),
        F.round(F.when(number(truth) > 0, F.coalesce(F.sum(F.when(truth, 1 / F.col("hit_rank"))), F.lit(0.0)) / number(truth)), 4).alias("mrr"),
        F.round(F.coalesce(F.avg(F.when(answered, F.col("groundedness"))), F.lit(0.0)), 4).alias("mean_groundedness"),
        F.coalesce(F.sum(F.when(answered, F.col("claims"))), F.lit(0)).alias("claims_emitted"),
        F.coalesce(F.sum(F.when(answered, F.col("dropped"))), F.lit(0)).alias("claims_rejected"),
    )
