"""What a document filter removes alone, behind others, and on average over all orders.

With n filters there are n * 2^(n-1) pairs of a set of filters already applied and the next one:
the edges of the lattice of sets. A document contributes to an edge by the set of filters that
it fails alone, so documents are first counted by part, failed set and label, and these few rows
contribute to all edges. An order of the filters is a path through the lattice: each of its steps is
one edge, so the figures of all orders are a join of the summed edges to the steps.

Failed sets are made of built-in functions on the text, in one reading. For the filter on copies
texts go by their SHA-256; rows of one id and text are counted together before anything else, a
text's rows are then merged by part and label, and only what is left meets in a window of one text.
So a text, an id or a part that holds a third of all rows is summed before it is shuffled.

Edge cases: null text counts as empty, null part as the empty string; a row without an id is no
copy and has no label; rows that repeat an id and a text are not copies of each other; of labels
that repeat an id the highest counts; documents without a label are in no label count; an empty
table gives no row; other columns of the inputs are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clauseforge.llm.common import let, quoted

BLANK = r"[\x20\x09-\x0D]+"
MIN_WORDS = 100
MIN_DISTINCT_PERCENT = 80
MAX_CAPITALS_PERCENT = 10
SYMBOLS = r"[#$%&*|]"
#: Name of the filter on copies, which looks at all texts.
COPIES = "E"


def capitals(text: Column) -> Column:
    """Number of characters A to Z, found by taking out the runs of all others."""
    return F.length(F.regexp_replace(text, "[^A-Z]++", ""))


#: Filters on one text: the condition of failure, from the text and its words.
FILTERS: dict[str, Callable[[Column, Column], Column]] = {
    "A": lambda text, words: F.size(words) < MIN_WORDS,
    "B": lambda text, words: F.size(F.array_distinct(words)) * 100 < F.size(words) * MIN_DISTINCT_PERCENT,
    "C": lambda text, words: capitals(text).cast("long") * 100 > F.length(text).cast("long") * MAX_CAPITALS_PERCENT,
    "D": lambda text, words: text.rlike(SYMBOLS),
}


def edges(n: int) -> list[tuple[int, int]]:
    """Every (set of filters already applied, next filter), filters as bits."""
    return [(applied, 1 << f) for applied in range(1 << n) for f in range(n) if not applied >> f & 1]


def orders_through(n: int, applied: int) -> int:
    """Number of orders that meet an edge whose applied set is ``applied``."""
    before = applied.bit_count()
    return factorial(before) * factorial(n - 1 - before)


def steps(names: list[str]) -> list[tuple[str, int, int, int]]:
    """(order, step, applied, next) of every step of every order."""
    out = []
    for order in permutations(range(len(names))):
        applied = 0
        for k, f in enumerate(order):
            out.append(("".join(names[x] for x in order), k + 1, applied, 1 << f))
            applied |= 1 << f
    return out


def failures(docs: DataFrame, id_col: str, text_col: str, part_col: str, filters: dict) -> DataFrame:
    """(id, part, text_key, failed, n): rows by id, text and part, with the filters on one text that it fails as bits."""

    def failed(x: Column) -> Column:
        bits = [F.when(fails(x["text"], x["words"]), 1 << k).otherwise(0) for k, fails in enumerate(filters.values())]
        total = bits[0]
        for b in bits[1:]:
            total = total + b
        return total.cast("int")

    text = F.coalesce(quoted(text_col), F.lit(""))
    both = F.struct(text.alias("text"), F.array_remove(F.split(text, BLANK), "").alias("words"))
    rows = docs.select(
        quoted(id_col).cast("long").alias("id"),
        F.coalesce(quoted(part_col).cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(text, 256)).alias("text_key"),
        let(both, failed).alias("failed"),
    )
    return rows.groupBy("id", "part", "text_key", "failed").agg(F.count("*").alias("n"))


def contributions(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang", filters: dict = FILTERS, copies: str | None = COPIES) -> DataFrame:
    """(part, failed, good, toxic, n): documents counted by part, failed set, and labels."""
    rows = failures(docs, id_col, text_col, part_col, filters)
    marks = labels.select(quoted(id_col).cast("long").alias("id"), F.coalesce(F.col("quality") == 1, F.lit(False)).alias("good"), F.coalesce(F.col("toxic") == 1, F.lit(False)).alias("toxic"))
    marks = marks.where("id is not null").groupBy("id").agg(F.max("good").alias("good"), F.max("toxic").alias("toxic"))
    # Rows without an id have a key of their text, so that they are spread and meet no label.
    rows = rows.withColumn("key", F.coalesce(F.col("id").cast("string"), F.concat(F.lit("-"), F.hex("text_key"))))
    marks = marks.select(F.col("id").cast("string").alias("key"), "good", "toxic")
    rows = rows.join(marks, "key", "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")})
    by = ["part", "failed", "good", "toxic"]
    if copies is None:
        return rows.groupBy(*by).agg(F.sum("n").alias("n"))
    known = F.col("id").isNotNull()
    merged = rows.groupBy("text_key", *by).agg(
        F.sum("n").alias("n"),
        F.coalesce(F.sum(F.when(~known, F.col("n"))), F.lit(0)).alias("unnamed"),
        F.min("id").alias("least"),
        F.min_by("n", "id").alias("n_least"),
    )
    # One row a part and label of a text, however many documents have it.
    first = F.col("least") == F.min("least").over(Window.partitionBy("text_key"))
    stays = F.col("unnamed") + F.when(first, F.col("n_least")).otherwise(0)
    split = F.explode(F.array(F.struct(F.col("failed").alias("failed"), F.col("stays").alias("n")), F.struct((F.col("failed") + (1 << len(filters))).alias("failed"), (F.col("n") - F.col("stays")).alias("n"))))
    two = merged.withColumn("stays", stays).select("part", "good", "toxic", split.alias("x")).select("part", "x.failed", "good", "toxic", "x.n")
    return two.where("n > 0").groupBy(*by).agg(F.sum("n").alias("n"))


def lattice(counts: DataFrame, n_filters: int) -> DataFrame:
    """(part, applied, next, kept, removed, redundant, unique_fails, good_lost, toxic_lost, weight) of every edge, zeros included."""
    one = F.explode(F.array(*(F.struct(F.lit(a).alias("applied"), F.lit(f).alias("next"), F.lit(orders_through(n_filters, a)).cast("long").alias("weight")) for a, f in edges(n_filters))))
    rows = counts.select("*", one.alias("e")).select("part", "failed", "good", "toxic", "n", "e.*")
    passed, fails = F.col("failed").bitwiseAND(F.col("applied")) == 0, F.col("failed").bitwiseAND(F.col("next")) != 0
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).cast("long")
    return rows.groupBy("part", "applied", "next", "weight").agg(
        total(passed & ~fails).alias("kept"),
        total(passed & fails).alias("removed"),
        total(~passed & fails).alias("redundant"),
        total(F.col("failed") == F.col("next")).alias("unique_fails"),
        total(passed & fails & F.col("good")).alias("good_lost"),
        total(passed & fails & F.col("toxic")).alias("toxic_lost"),
    )


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang", filters: dict = FILTERS, copies: str | None = COPIES) -> DataFrame:
    """(part, filter_order, step, filter, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) of every step of every order.

    ``filters`` are conditions on one text by name, ``copies`` the name of the one on equal texts of
    smaller ids, None for none; ``labels`` (id, quality, toxic). shapley sums what the filter removes
    over all orders.
    """
    names = [*filters, *([copies] if copies else [])]
    spark = docs.sparkSession
    edge = lattice(contributions(docs, labels, id_col, text_col, part_col, filters, copies), len(names))
    shapley = F.sum(F.col("removed") * F.col("weight")).over(Window.partitionBy("part", "next"))
    edge = edge.withColumn("shapley", shapley).drop("weight")
    # n * n! rows, by the number of filters alone.
    path = spark.createDataFrame(steps(names), "filter_order string, step int, applied int, next int")
    out = edge.join(F.broadcast(path), ["applied", "next"])
    return out.select("part", "filter_order", "step", F.substring("filter_order", F.col("step"), F.lit(1)).alias("filter"), "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


#: The same by brute force: each document, each order, each step.
SQL = r"""WITH words AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
firsts AS (SELECT t, min(doc_id) AS least FROM words GROUP BY t),
marks AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
judged AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, CASE WHEN len(w) < 100 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 2 ELSE 0 END
  + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) THEN 4 ELSE 0 END + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN doc_id > least THEN 16 ELSE 0 END AS failed
  FROM words JOIN firsts USING (t) LEFT JOIN marks USING (doc_id)),
names AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
orders AS (SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM names a, names b, names c, names d, names e WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
steps AS (SELECT filter_order, k AS step, substr(filter_order, k, 1) AS filter, CAST(list_sum(list_transform(range(1, k), lambda i: 1 << (ascii(substr(filter_order, i, 1)) - 65))) AS INTEGER) AS s, 1 << (ascii(substr(filter_order, k, 1)) - 65) AS f FROM orders, (SELECT unnest(range(1, 6)) AS k)),
counts AS (SELECT part, failed, good, toxic, count(*) AS n FROM judged GROUP BY ALL),
met AS (SELECT part, filter_order, step, filter, failed & coalesce(s, 0) = 0 AS passed, failed & f <> 0 AS fails, failed = f AS only_it, good, toxic, n FROM counts, steps),
figures AS (SELECT part, filter_order, step, filter, sum(CASE WHEN passed AND NOT fails THEN n ELSE 0 END) AS kept, sum(CASE WHEN passed AND fails THEN n ELSE 0 END) AS removed, sum(CASE WHEN fails AND NOT passed THEN n ELSE 0 END) AS redundant,
  sum(CASE WHEN only_it THEN n ELSE 0 END) AS unique_fails, sum(CASE WHEN passed AND fails THEN n * good ELSE 0 END) AS good_lost, sum(CASE WHEN passed AND fails THEN n * toxic ELSE 0 END) AS toxic_lost FROM met GROUP BY part, filter_order, step, filter)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, filter, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, filter) AS BIGINT) AS shapley FROM figures"""
