"""From ranked hits to answers: gate, context, sources, extractive lines, assembly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clauseforge.functions import text as T
from clauseforge.operators.retrieval import nine, total

#: Thresholds of the gate and the verifier, sizes of contexts and quotes.
MIN_TOP, MIN_SUPPORT, MIN_OVERLAP, MIN_CLAIM_SUPPORT = 0.20, 0.18, 0.08, 0.45
CONTEXT_CHARS = 14_000
QUOTE_CHARS = (40, 400)
REFUSAL = "The indexed documents hold no passage that supports an answer to this question."
NO_HITS = "retrieval returned no candidates"


def signals(questions: DataFrame, hits: DataFrame) -> DataFrame:
    """(qid, top, support, overlap, hits): best score, mean of hits 2 and 3, best overlap of the first three."""
    at = lambda a, b: F.when(F.col("rank").between(a, b), F.col("score"))
    rows = hits.groupBy("qid").agg(
        F.max(at(1, 1)).alias("top"),
        F.avg(at(2, 3)).alias("support"),
        F.max(F.when(F.col("rank") <= 3, F.col("overlap"))).alias("overlap"),
        F.count("*").alias("hits"),
    )
    zero = {c: F.coalesce(c, F.lit(0.0)) for c in ("top", "support", "overlap")}
    return questions.select("qid").join(rows, "qid", "left").withColumns(zero).withColumn("hits", F.coalesce("hits", F.lit(0)))


def gate(sig: DataFrame, unknown: DataFrame | None = None, missing: DataFrame | None = None, min_top: float = MIN_TOP, min_support: float = MIN_SUPPORT, min_overlap: float = MIN_OVERLAP) -> DataFrame:
    """(qid, answerable, reason, confidence, top, support, overlap), by the first rule that refuses."""
    rows = sig
    if missing is not None:
        names = missing.groupBy("qid").agg(F.array_sort(F.collect_set("spec_id")).alias("_missing"))
        rows = rows.join(names, "qid", "left")
    else:
        rows = rows.withColumn("_missing", F.lit(None).cast("array<string>"))
    if unknown is not None:
        terms = unknown.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("ord", "term"))).alias("_unknown"))
        rows = rows.join(terms, "qid", "left").withColumn("_unknown", F.transform("_unknown", lambda x: x["term"]))
    else:
        rows = rows.withColumn("_unknown", F.lit(None).cast("array<string>"))
    two = lambda c: F.format_string("%.2f", F.col(c))
    quoted = F.array_join(F.transform(F.slice("_unknown", 1, 4), lambda t: F.concat(F.lit("'"), t, F.lit("'"))), ", ")
    reason = (
        F.when(F.col("hits") == 0, NO_HITS)
        .when(F.size(F.coalesce("_missing", F.array())) > 0, F.concat(F.array_join("_missing", ", "), F.lit(" is not in the index")))
        .when(F.size(F.coalesce("_unknown", F.array())) > 0, F.concat(F.lit("no indexed document mentions "), quoted))
        .when(F.col("top") < min_top, F.concat(F.lit("best passage scored "), two("top"), F.lit(f", below {min_top:.2f}")))
        .when(F.col("overlap") < min_overlap, F.concat(F.lit("the question's words hardly occur (overlap "), two("overlap"), F.lit(")")))
        .when((F.col("support") < min_support) & (F.col("top") < min_top * 1.6), F.concat(F.lit("one weak passage alone (support "), two("support"), F.lit(")")))
        .otherwise("sufficient support")
    )
    confidence = F.when(F.col("hits") == 0, 0.0).otherwise(F.round(0.60 * F.col("top") + 0.25 * F.col("support") + 0.15 * F.col("overlap"), 4))
    rows = rows.withColumn("reason", reason).withColumn("confidence", confidence)
    return rows.select("qid", (F.col("reason") == "sufficient support").alias("answerable"), "reason", "confidence", "top", "support", "overlap")


def within_budget(hits: DataFrame, block: Column, budget: int = CONTEXT_CHARS) -> DataFrame:
    """Hits before the first that would take the blocks over the budget; the first stays in any case."""
    order = Window.partitionBy("qid").orderBy("rank")
    rows = hits.withColumn("_sum", F.sum(F.length(block)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    over = F.max(F.when((F.col("_sum") > budget) & (F.col("rank") > 1), 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("_over", over).where("_over = 0").drop("_sum", "_over").withColumn("n", F.col("rank"))


def quotable(text: Column) -> Column:
    """Array of the sentences that can be quoted, table lines left out, in order."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(" \t\r"))), lambda x: (x != "") & ~x.startswith("|"))
    spans = F.flatten(F.transform(lines, T.answer_sentences))
    flat = F.transform(spans, lambda s: F.btrim(F.regexp_replace(s, r"(?U)\s+", " "), F.lit(" -\t")))
    return F.filter(flat, lambda s: F.length(s).between(*QUOTE_CHARS))


def extractive(hits: DataFrame, terms: DataFrame, limit: int = 3, per_hit: int = 2) -> DataFrame:
    """(qid, n, line, text): of each of the first hits (qid, n, text) the best sentences, with their marker."""
    rows = hits.where(F.col("n") <= limit).join(terms, "qid", "left").select("qid", "n", "terms", F.posexplode(quotable(F.col("text"))).alias("ord", "sentence"))
    score = F.coalesce(T.once(F.lower("sentence"), lambda s: total(F.col("terms"), lambda t: s.contains(t["term"]))), F.lit(0.0))
    order = Window.partitionBy("qid", "n").orderBy(nine("score").desc(), "ord")
    best = rows.withColumn("score", score).withColumn("line", F.row_number().over(order).cast("long")).where(F.col("line") <= per_hit)
    return best.select("qid", "n", "line", F.concat("sentence", F.lit(" [S"), F.col("n").cast("string"), F.lit("]")).alias("text"))


def assembled(questions: DataFrame, gated: DataFrame, claims: DataFrame, drop_unverified: bool = True) -> DataFrame:
    """(qid, answer, abstained, reason, groundedness, kept, claims) of verified claims (qid, claim_no, text, citations, supported)."""
    shown = claims.where("supported") if drop_unverified else claims
    marks = F.array_join(F.transform("citations", lambda n: F.concat(F.lit("[S"), n.cast("string"), F.lit("]"))), "")
    lines = shown.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("claim_no", F.concat("text", F.lit(" "), marks).alias("line")))).alias("_lines"))
    counts = claims.groupBy("qid").agg(F.count("*").alias("claims"), F.sum(F.col("supported").cast("long")).alias("kept"))
    rows = questions.select("qid").join(gated.select("qid", "answerable", "reason"), "qid").join(lines, "qid", "left").join(counts, "qid", "left")
    text = F.array_join(F.transform("_lines", lambda x: x["line"]), "\n")
    good = F.col("answerable") & F.col("_lines").isNotNull()
    reason = F.when(~F.col("answerable") | good, F.col("reason")).otherwise("no claim is grounded in the passage that it cites")
    grounded = F.when(good, F.round(F.col("kept") / F.col("claims"), 4)).otherwise(0.0)
    return rows.select("qid", F.when(good, text).otherwise(REFUSAL).alias("answer"), (~good).alias("abstained"), reason.alias("reason"), grounded.alias("groundedness"), F.coalesce("kept", F.lit(0)).alias("kept"), F.coalesce("claims", F.lit(0)).alias("claims"))
