"""Checks of an answer's claims against the passages that they cite."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clauseforge.functions import text as T
from clauseforge.operators.answers import MIN_CLAIM_SUPPORT
from clauseforge.operators.retrieval import UNKNOWN_IDF

MARKER = r"\[S(\d+)\]"
#: Patterns of tokens that a claim may not invent, in the order in which they are listed.
HARD = (
    r"(?Ui)\b(?:TS|TR)\s?\d{2}\.\d{3}\b",
    r"(?U)\bT\d{3,4}[A-Za-z]?\b",
    r"(?U)\b0x[0-9A-Fa-f]+\b",
    r"(?U)\b[A-Z][A-Z0-9-]{2,}(?:\s+[A-Z][A-Z0-9-]{2,})+\b",
    r"(?U)\b[A-Z][A-Z0-9]{2,}(?:[-/][A-Z0-9]+)*\b",
    r"(?U)(?<![\w.])\d+(?:\.\d+)*(?!\w)",
)
#: Upper-case words too common in the field to stand for a value.
AMBIENT = ("UE", "NAS", "3GPP", "TS", "TR", "THE", "AND", "NOTE", "IE", "PDU", "NR", "AMF", "SMF")


def claims(answers: DataFrame) -> DataFrame:
    """(qid, claim_no, text, citations) of answers (qid, answer): one claim a line with any text beside its markers."""
    # Not F.trim itself: transform would hand it the number of the line as the characters to trim.
    lines = F.filter(F.transform(F.split("answer", r"\R"), lambda x: F.trim(x)), lambda x: x != "")
    rows = answers.select("qid", F.posexplode(lines).alias("line", "raw")).withColumn("raw", F.regexp_replace("raw", r"^[-*•]\s*", ""))
    cites = F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all("raw", F.lit(MARKER), F.lit(1)), lambda n: n.cast("int"))))
    text = F.trim(F.regexp_replace(F.trim(F.regexp_replace("raw", r"(?:\s*\[S\d+\])+\s*$", "")), MARKER, ""))
    rows = rows.select("qid", "line", text.alias("text"), cites.alias("citations")).where("text <> ''")
    return rows.select("qid", F.col("line").cast("long").alias("claim_no"), "text", "citations")


def hard_tokens(text: Column) -> Column:
    """Values in a text, by kind and place; of tokens alike but for case and spaces the first.

    The text, its values and their keys are each made once a row, not once for every value.
    """

    def values(t: Column) -> Column:
        hits = [F.regexp_extract_all(t, F.lit(pattern), F.lit(0)) for pattern in HARD]
        hits[4] = F.filter(hits[4], lambda v: ~v.isin(*AMBIENT))
        return F.concat(*hits)

    def keyed(every: Column) -> Column:
        return F.struct(every.alias("values"), F.transform(every, T.normalised).alias("keys"))

    def first(both: Column) -> Column:
        return F.filter(both["values"], lambda v, i: F.array_position(both["keys"], F.get(both["keys"], i)) == i + 1)

    return T.once(T.once(T.once(text, values), keyed), first)


def present(token: Column, source: Column, tokens: Column, strict: bool = False) -> Column:
    """Whether a value occurs in the normalised text or tokens of the sources; ``strict`` asks for bounds around it."""
    key = T.normalised(token)
    packed = F.replace(source, F.lit(" "), F.lit(""))
    inner = F.lit(False) if strict else packed.contains(F.replace(key, F.lit(" "), F.lit("")))
    return F.when(key.contains(" "), source.contains(key)).otherwise(F.array_contains(tokens, key) | inner)


def verified(parsed: DataFrame, sources: DataFrame, idf: DataFrame, least: float = MIN_CLAIM_SUPPORT, strict: bool = False) -> DataFrame:
    """Verdicts (qid, claim_no, text, citations, supported, support, ungrounded, reason).

    ``sources`` (qid, n, text) are the passages offered; citations of others do not count. Passages
    cited together are read as one text.
    """
    each = parsed.select("qid", "claim_no", F.explode("citations").alias("n"))
    src = sources.select("qid", F.col("n").cast("int").alias("n"), T.normalised("text").alias("_s"), T.tokens("text", True).alias("_t"))
    cited = each.join(src, ["qid", "n"]).groupBy("qid", "claim_no").agg(F.array_sort(F.collect_list(F.struct("n", "_s", "_t"))).alias("_c"))
    rows = parsed.select("qid", "claim_no", "text").join(cited, ["qid", "claim_no"], "left")
    rows = rows.withColumn("valid", F.transform("_c", lambda x: x["n"])).withColumn("merged", F.array_join(F.transform("_c", lambda x: x["_s"]), " ")).withColumn("tokens", F.array_distinct(F.flatten(F.transform("_c", lambda x: x["_t"]))))
    bad = F.filter(hard_tokens(F.col("text")), lambda t: ~present(t, F.col("merged"), F.col("tokens"), strict))
    rows = rows.withColumn("ungrounded", F.when(F.col("valid").isNull(), F.array().cast("array<string>")).otherwise(bad))
    terms = rows.select("qid", "claim_no", "merged", F.explode(F.array_distinct(T.tokens("text"))).alias("term")).join(idf.select("term", "idf"), "term", "left")
    weight = F.coalesce("idf", F.lit(UNKNOWN_IDF))
    share = terms.groupBy("qid", "claim_no").agg((F.sum(F.when(F.col("merged").contains(F.col("term")), weight).otherwise(0.0)) / F.sum(weight)).alias("support"))
    rows = rows.join(share, ["qid", "claim_no"], "left").withColumn("support", F.when(F.col("valid").isNull(), 0.0).otherwise(F.coalesce("support", F.lit(0.0))))
    clean = F.size("ungrounded") == 0
    reason = (
        F.when(F.col("valid").isNull(), "no valid citation")
        .when(~clean, F.concat(F.lit("not in the cited passage: "), F.array_join(F.slice("ungrounded", 1, 5), ", ")))
        .when(F.round("support", 9) < least, F.concat(F.lit("weak support ("), F.format_string("%.2f", "support"), F.lit(")")))
        .otherwise("grounded")
    )
    rows = rows.withColumn("reason", reason).withColumn("citations", F.coalesce("valid", F.array().cast("array<int>")))
    return rows.select("qid", "claim_no", "text", "citations", (F.col("reason") == "grounded").alias("supported"), "support", "ungrounded", "reason")


def groundedness(verdicts: DataFrame, answers: DataFrame) -> DataFrame:
    """(qid, claims, kept, groundedness); 0 where there is no claim."""
    rows = verdicts.groupBy("qid").agg(F.count("*").alias("claims"), F.sum(F.col("supported").cast("long")).alias("kept"))
    rows = answers.select("qid").join(rows, "qid", "left").fillna(0, ["claims", "kept"])
    return rows.select("qid", "claims", "kept", F.when(F.col("claims") > 0, F.col("kept") / F.col("claims")).otherwise(0.0).alias("groundedness"))


def entailment(claims_: DataFrame, replies: DataFrame) -> DataFrame:
    """Verdicts overridden by a judge's replies (qid, reply): lines "number: SUPPORTED" or "number: NOT_SUPPORTED"."""
    pattern = r"(?i)^\s*(\d+)\s*[:.)-]\s*(SUPPORTED|NOT_SUPPORTED)"
    lines = replies.select("qid", F.posexplode(F.split("reply", r"\R")).alias("at", "line")).where(F.col("line").rlike(pattern))
    verdict = lines.groupBy("qid", F.regexp_extract("line", pattern, 1).cast("long").alias("number")).agg(F.max_by(F.upper(F.regexp_extract("line", pattern, 2)), "at").alias("entailment"))
    from pyspark.sql import Window

    number = F.row_number().over(Window.partitionBy("qid").orderBy("claim_no")).cast("long")
    rows = claims_.withColumn("number", number).join(verdict, ["qid", "number"], "left").drop("number")
    against = F.coalesce(F.col("entailment") == "NOT_SUPPORTED", F.lit(False))
    return rows.withColumn("supported", F.col("supported") & ~against).withColumn("reason", F.when(against, "the judge finds no support in the cited passage").otherwise(F.col("reason")))
