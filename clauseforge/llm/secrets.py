"""Secret scans over an incremental ledger of blobs, in built-in functions only.

Every version of a text is addressed by the SHA-256 of its content. A blob is scanned once for
each version of the rules: pairs of blob and rule version that the ledger holds already are
left out by an anti join, the rest are scanned, and findings are joined back to every path that
has the blob. Copies meet in the map-side part of an aggregation, so a blob that a third of the
rows share is shuffled once for each task. Only blobs with findings are joined back; the rows of
one blob are then a skewed side of a left join, which Spark splits as it runs.

A stored ledger is a folder of runs. A run is written under a hidden name and renamed when it is
whole, so readers see all of it or nothing; a blob that two runs scanned at once is read once.
The version of the rules is a hash of the patterns, so changed rules never meet old findings.
A ledger holds places and kinds, never text.

Edge cases: null text is the empty blob and has no findings; copies and repeated rows have the
findings of their blob; an empty table gives no rows; long texts are read whole; columns of the
input other than the id and the text are left alone.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clauseforge.llm.common import fresh, quoted
from clauseforge.llm.spans import found, listed, redacted
from clauseforge.session import remove, shared_folder

KINDS = ["assign", "access", "hex", "forge", "chat", "jwt", "pem", "login"]
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*+[:=]\x20*+["']?([A-Za-z0-9+/_.=-]++)"""
PEM = "-----{} [A-Z0-9 ]*+(?<= PRIVATE KEY)-----"
#: A private key runs to its END line; without one, before the next BEGIN, over its headers and what may be its body.
#: Patterns by kind: those of the first three kinds are the base, the others are added to it.
RULES = {
    "assign": ASSIGN,
    "access": r"AKIA[A-Z0-9]{16,}+",
    "hex": r"(?<![0-9a-f])[0-9a-f]{24,}+",
    "forge": r"(?<![A-Za-z0-9_])(?:gh[pousr]_[A-Za-z0-9]{36,}+|glpat-[A-Za-z0-9_-]{20,}+)",
    "chat": r"(?<![A-Za-z0-9_])xox[abprs]-[A-Za-z0-9-]{10,}+",
    "jwt": r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+",
    "pem": rf"{PEM.format('BEGIN')}(?:(?:[^-]++|-(?!----(?:BEGIN|END) ))*+{PEM.format('END')}|(?:\s*+(?:Proc-Type|DEK-Info|Version|Comment):[^\n]*+\n)*+[A-Za-z0-9+/=\s]*+)",
    "login": r"(?<![A-Za-z0-9+.-])[a-z][a-z0-9+.-]++://[^\s:/@]++:[^\s:/@]++@",
}
#: A text without any of these holds no added span.
ADDED = r"gh[pousr]_|glpat-|xox[abprs]-|eyJ|-----BEGIN |://"
#: Characters of group 2 that an assignment has at least.
ASSIGNED = 6
RULE_VERSION = hashlib.sha256(repr((RULES, ADDED, ASSIGNED)).encode()).hexdigest()[:16]
LEDGER = "blob_id string, rule_version string, findings array<struct<s:int,k:int,e:int>>"
FINDING = "array<struct<s:int,k:int,e:int>>"


def of_kind(hits: Column, k: int) -> Column:
    return F.transform(hits, lambda x: F.struct(x["s"].alias("s"), F.lit(k).alias("k"), x["e"].alias("e")))


def scan(text: Column) -> Column:
    """Findings of one text as structs (s, k, e), by start and kind."""
    out = []
    for k, kind in enumerate(KINDS):
        hits = found(text, RULES[kind], None if k < 3 else text.rlike(ADDED))
        if kind == "assign":
            hits = F.filter(hits, lambda x: F.length(F.regexp_extract(x["m"], ASSIGN, 1)) >= ASSIGNED)
        out.append(of_kind(hits, k))
    return F.sort_array(F.concat(*out)).cast(FINDING)


def blob_id(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def scan_blobs(docs: DataFrame, ledger: DataFrame | None = None, text_col: str = "text", rule_version: str = RULE_VERSION) -> DataFrame:
    """Ledger rows (blob_id, rule_version, findings) of the pairs that ``ledger`` lacks."""
    text = F.coalesce(quoted(text_col), F.lit(""))
    blobs = docs.select(text.alias("text"), blob_id(quoted(text_col)).alias("blob_id")).groupBy("blob_id").agg(F.first("text").alias("text"))
    if ledger is not None:
        blobs = blobs.join(ledger.where(F.col("rule_version") == rule_version).select("blob_id"), "blob_id", "left_anti")
    return blobs.select("blob_id", F.lit(rule_version).alias("rule_version"), scan(F.col("text")).alias("findings"))


def ledger_folder(spark: SparkSession) -> str:
    """Where queries and the pipeline keep their ledger."""
    return f"{shared_folder(spark)}/secret-ledger"


def stored(spark: SparkSession, path: str) -> DataFrame | None:
    """The ledger below ``path``; None if no run is there yet."""
    runs = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/run-*")
    if not runs.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(runs):
        return None
    return spark.read.schema(LEDGER).parquet(f"{path}/run-*")


def record(docs: DataFrame, path: str, text_col: str = "text", rule_version: str = RULE_VERSION) -> DataFrame:
    """Scan the blobs that the ledger below ``path`` lacks, add them to it, and return it."""
    spark, name = docs.sparkSession, uuid.uuid4().hex
    hidden, whole = f"{path}/_new-{name}", f"{path}/run-{name}"
    try:
        scan_blobs(docs, stored(spark, path), text_col, rule_version).write.parquet(hidden)
    except BaseException:
        remove(spark, hidden)
        raise
    if stored(spark, path) is not None and spark.read.schema(LEDGER).parquet(hidden).isEmpty():
        remove(spark, hidden)
    else:
        place = spark._jvm.org.apache.hadoop.fs.Path
        place(hidden).getFileSystem(spark._jsc.hadoopConfiguration()).rename(place(hidden), place(whole))
    return stored(spark, path)


def findings(docs: DataFrame, out: str, ledger: DataFrame | None = None, text_col: str = "text", rule_version: str = RULE_VERSION, path: str | None = None) -> DataFrame:
    """``docs`` with a column ``out``: the spans (s, k, e) of each row's blob, from the ledger or a new scan.

    With ``path`` the ledger below it is brought up to date first and holds all findings.
    """
    if path is not None:
        known, rows = record(docs, path, text_col, rule_version), None
    else:
        known, rows = ledger, scan_blobs(docs, ledger, text_col, rule_version)
    if known is not None:
        held = known.where(F.col("rule_version") == rule_version)
        rows = held if rows is None else rows.unionByName(held)
    (blob,) = fresh(docs, "_blob")
    hits = rows.where(F.size("findings") > 0).groupBy(F.col("blob_id").alias(blob)).agg(F.first("findings").alias(out))
    keyed = docs.withColumn(blob, blob_id(quoted(text_col)))
    return keyed.join(hits, blob, "left").withColumn(out, F.coalesce(out, F.array().cast(FINDING))).drop(blob)


def redact(docs: DataFrame, ledger: DataFrame | None = None, text_col: str = "text", path: str | None = None) -> DataFrame:
    """``docs`` with every finding in the text replaced by its kind in brackets."""
    names, (out,) = F.array(*map(F.lit, KINDS)), fresh(docs, "_findings")
    by_start = F.transform(out, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["k"].alias("k")))
    text = redacted(quoted(text_col), by_start, lambda x: F.concat(F.lit("["), F.get(names, x["k"]), F.lit("]")))
    return findings(docs, out, ledger, text_col, path=path).withColumn(text_col, text).select(*map(quoted, docs.columns))


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """Per row: the id, counts of the base kinds, the hash of the base spans, and all spans."""
    rows = findings(docs.select(quoted(id_col), quoted(text_col)), "_findings", text_col=text_col, path=path)
    base = F.filter("_findings", lambda x: x["k"] < 3)
    count = lambda k: F.size(F.filter("_findings", lambda x: x["k"] == k)).cast("long")
    return rows.select(
        id_col,
        *(count(k).alias(f"n_{KINDS[k]}") for k in range(3)),
        F.sha2(listed(base, KINDS), 256).alias("base_sha256"),
        listed(F.col("_findings"), KINDS).alias("spans"),
    )
