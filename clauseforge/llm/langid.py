"""Language identification by word-first backoff.

A known word is scored by its log frequency in each language. An unseen word falls back to its
character n-grams of the longest order of which the model knows any, then to ever shorter ones.
Counts come from a bounded sample of labelled rows, FIT_DOCS at most of each language however rare
it is, and are made by the DataFrame engine. The model holds every word and n-gram that the sample
has at least MIN_COUNT times over all languages, with its count in each of them, so the sample
bounds its size whatever the corpus, and it is what the workers receive.

Edge cases: text that is null or has no letter is ``und`` with score 0; a table without labelled
rows makes every row ``und``; rows with a null label are not learnt from; equal scores go to the
language that sorts first; repeated rows are scored one by one, and an id that repeats is learnt
from once; other columns are not looked at.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clauseforge.llm.common import bounded_batches, cut, quoted

#: Labelled rows of the sample, at most so many of each language.
FIT_DOCS = 2_000
ORDERS = (5, 4, 3, 2, 1)
#: A word or n-gram must have been seen this often, in all languages together.
MIN_COUNT = 3
LETTERS = re.compile(r"[^\W\d_]+")
MEMO = 200_000
#: Rows of (language, hash) that are broadcast, at most; with more languages than that the rows are shuffled.
BROADCAST_ROWS = 100_000


def sample(docs: DataFrame, fit_docs: int = FIT_DOCS, id_col: str = "doc_id", lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(lang, text) of up to ``fit_docs`` rows of each language.

    Ids are hashed into ``fit_docs`` buckets, and each bucket gives the row of its least hash: no
    count of the rows is needed, partial minima are all that is shuffled, and no table is too large.
    """
    rows = docs.select(quoted(lang_col).alias("lang"), F.xxhash64(quoted(id_col).cast("string")).alias("h"), quoted(text_col).alias("text"))
    least = rows.groupBy("lang", F.pmod("h", F.lit(fit_docs)).alias("bucket")).agg(F.min("h").alias("h")).select("lang", "h")
    least = cut(least)  # at most fit_docs rows of each language
    if least.count() <= BROADCAST_ROWS:
        least = F.broadcast(least)
    return rows.join(least, ["lang", "h"], "left_semi").groupBy("lang", "h").agg(F.min("text").alias("text")).select("lang", "text")


def fit(train: DataFrame) -> "Model":
    """The model of (lang, text); rows without a language or text are skipped."""
    word = F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0)))
    words = train.where("lang IS NOT NULL AND text IS NOT NULL").select("lang", word.alias("x")).groupBy("lang", "x").agg(F.count("*").alias("n"))
    words = cut(words)  # counts of a bounded sample
    marked = lambda o: F.concat(F.lit("<"), F.col("x"), F.lit(">")) if o > 1 else F.col("x")
    many = lambda o: F.greatest(F.length(marked(o)) - (o - 1), F.lit(0))

    def grams(o: int) -> Column:
        one = lambda i: F.struct(F.lit(o).alias("o"), F.substr(marked(o), i, F.lit(o)).alias("x"))
        return F.when(many(o) > 0, F.transform(F.sequence(F.lit(1), many(o)), one)).otherwise(F.array().cast("array<struct<o:int,x:string>>"))

    units = F.explode(F.concat(F.array(F.struct(F.lit(0).alias("o"), F.col("x").alias("x"))), *map(grams, ORDERS)))
    each = words.select("lang", "n", units.alias("u")).groupBy("u.o", "u.x", "lang").agg(F.sum("n").alias("n"))
    kept = each.groupBy("o", "x").agg(F.collect_list(F.struct("lang", "n")).alias("by"), F.sum("n").alias("total")).where(F.col("total") >= MIN_COUNT)
    totals = words.groupBy("lang").agg(F.sum("n").alias("t0"), *(F.sum(F.col("n") * many(o)).alias(f"t{o}") for o in ORDERS))
    return Model(kept.select("o", "x", "by").sort("o", "x").toArrow(), {r.lang: [r[f"t{o}"] for o in range(max(ORDERS) + 1)] for r in totals.collect()})


class Model:
    def __init__(self, entries: pa.Table, totals: dict[str, list[int]]):
        """``entries``: (o, x, by), by being a list of (lang, n); ``totals``: counts of each order by language."""
        self.langs = sorted(totals)
        self.known: dict[str, int] = {}
        self.grams: list[dict[str, int]] = [{} for _ in range(max(ORDERS) + 1)]
        orders, names = entries["o"].to_pylist(), entries["x"].to_pylist()
        for k, (o, x) in enumerate(zip(orders, names)):
            (self.known if o == 0 else self.grams[o])[x] = k
        by = entries["by"].combine_chunks()
        by = by.chunk(0) if isinstance(by, pa.ChunkedArray) else by
        counts = np.zeros((len(names), len(self.langs)))
        if len(names):
            owner = np.repeat(np.arange(len(names)), np.asarray(pa.compute.list_value_length(by)))
            flat, place = by.flatten(), {lang: k for k, lang in enumerate(self.langs)}
            counts[owner, [place[x] for x in flat.field("lang").to_pylist()]] = flat.field("n").to_numpy()
        total = np.array([totals[lang] for lang in self.langs], float).T
        table = np.log((counts + 0.1) / (total[np.array(orders, int)] + 1)) if len(names) else counts
        #: Only differences between languages matter, so each entry is kept relative to its mean.
        self.size = len(names)
        self.table = (table - (table.mean(axis=1, keepdims=True) if len(names) else 0)).astype(np.float32)
        self.met: dict[str, int] = {}

    def backoff(self, word: str) -> np.ndarray:
        """The mean over the word's n-grams of the longest order that the model knows."""
        marked = f"<{word}>"
        for order in ORDERS:
            source, table = (marked if order > 1 else word), self.grams[order]
            rows = [table[g] for i in range(len(source) - order + 1) if (g := source[i : i + order]) in table]
            if rows:
                return self.table[rows].mean(axis=0)
        return np.zeros(len(self.langs), np.float32)

    def rows_of(self, words: list[str]) -> list[int]:
        """A row of the table for each word; rows of unseen words are made once and kept up to a bound."""
        if len(self.met) - len(self.known) > MEMO or not self.met:
            self.met, self.table = dict(self.known), self.table[: self.size]
            self.spare = self.size
        new = {w for w in words if w not in self.met}
        if new:
            if self.spare + len(new) > len(self.table):
                more = np.zeros((len(new) + MEMO // 4, len(self.langs)), np.float32)
                self.table = np.concatenate([self.table[: self.spare], more])
            for w in new:
                self.table[self.spare] = self.backoff(w)
                self.met[w] = self.spare
                self.spare += 1
        return list(map(self.met.__getitem__, words))

    def predict(self, text: str | None) -> tuple[str, float]:
        found = LETTERS.findall(text.lower()) if text else []
        if not self.langs or not any(map(str.isalpha, found)):
            return "und", 0.0
        rows = self.rows_of(found)
        total = self.table[rows].sum(axis=0, dtype=np.float64)
        mean = total / math.sqrt(len(found))
        odds = np.exp(mean - mean.max())
        best = int(np.argmax(total))
        return self.langs[best], float(odds[best] / odds.sum())


def _predict(model):
    def run(batches):
        for batch in batches:
            found = [model.value.predict(t) for t in batch.column(2).to_pylist()]
            lang, score = (pa.array(c, k) for c, k in zip(zip(*found) if found else ([], []), (pa.string(), pa.float64())))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lang, score], names=["id", "held_out", "lang_pred", "score"])

    return run


def is_held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string")) % 3 == 1, F.lit(False))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", fit_docs: int = FIT_DOCS) -> DataFrame:
    """(id, held_out, lang_pred, score) per row of ``docs``, learnt from rows that are not held out."""
    spark = docs.sparkSession
    bounded_batches(spark)
    out = is_held_out(quoted(id_col))
    model = fit(sample(docs.where(~out & quoted(lang_col).isNotNull()), fit_docs, id_col, lang_col, text_col))
    kept = docs.select(quoted(id_col).cast("long").alias("id"), out.alias("held_out"), quoted(text_col).alias("text"))
    rows = kept.mapInArrow(_predict(spark.sparkContext.broadcast(model)), "id long, held_out boolean, lang_pred string, score double")
    return rows.withColumnRenamed("id", id_col)
