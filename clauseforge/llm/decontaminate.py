"""Benchmark decontamination: a BM25 inverted index of the test items, searched by every training passage.

An item is indexed as up to three units: the whole, its question (all but the last sentence) and
its answer (the last sentence), parts of PART_WORDS words or more. A passage holds an item if it
has at least 80 % of the five-word shingles of one of its units: the whole, or the question, or the
answer alone. Impacts are divided by what a unit must reach at least, so that one threshold, 1,
serves all: a unit whose shingles are to 80 % in a passage lacks at most a known number of its
words, and the bound assumes that these are its weightiest. Retrieval therefore loses no unit that
the check of shingles would accept. Passages are windows of twice the longest item's length, each
overlapping the next by half, so an item lies wholly in one of them.

A batch of passages first adds up the impacts of rare terms, which gives (passage, unit) pairs
whose upper bound reaches the threshold; only those passages are searched by block-max WAND. Each
unit it returns is checked by its shingles, compared by 64-bit hashes.

The index is what is sent to the workers. Items are read as a stream and gathered until their
index has about INDEX_BYTES; each such block is one pass over the documents, and the driver holds
one block at a time, so nothing that is gathered or broadcast grows without bound.

Edge cases: null and empty texts have no passage; items without a word are left out; shorter units
than a shingle must occur whole; repeated items and rows are each reported; an empty table of
items or documents gives no row; other columns of either table are not looked at.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clauseforge.llm.common import bounded_batches, quoted

K1, B = 1.2, 0.75
SHINGLE = 5
SIMILARITY = 0.8
#: Words that a question or an answer has at least to count without the rest of its item.
PART_WORDS = 8
INDEX_BYTES = 48 << 20
POSTING_BLOCK = 16
#: A term in more than this share of the units counts as frequent: it bounds, but does not admit.
FREQUENT = 0.02
#: Posting lists that a worker keeps unpacked.
UNPACKED = 4096
WORDS = re.compile(r"\w+")
SENTENCE = re.compile(r"(?<=[.!?])\s+")
SCHEMA = "doc_id long, item_id long, passage long, score double, overlap double, question_overlap double, answer_overlap double"


def words(text: str | None) -> list[str]:
    return WORDS.findall(text.lower()) if text else []


def shingles(tokens: list[str], size: int = SHINGLE) -> np.ndarray:
    """Sorted hashes of the different shingles; a shorter text is one shingle."""
    import xxhash

    size = min(size, len(tokens))
    if not size:
        return np.zeros(0, np.uint64)
    return np.unique(np.array([xxhash.xxh64_intdigest(" ".join(tokens[i : i + size])) for i in range(len(tokens) - size + 1)], np.uint64))


def parts_of(text: str) -> tuple[list[str], list[str]]:
    """The words of the question and of the answer; one sentence alone is neither."""
    sentences = [s for s in map(words, SENTENCE.split(text)) if s]
    return ([x for s in sentences[:-1] for x in s], sentences[-1]) if len(sentences) > 1 else ([], [])


class Index:
    """Postings by term, in blocks that know their largest impact."""

    def __init__(self, items: list[tuple[int, str | None]], similarity: float = SIMILARITY, size: int = SHINGLE):
        self.similarity, self.size = similarity, size
        kept = [(i, t, w) for i, t in items if (w := words(t))]
        self.ids = [i for i, _, _ in kept]
        self.span = max([64, *(len(w) for _, _, w in kept)])
        #: By item its units: number of words in a shingle, and the shingles.
        self.parts: list[list[tuple[int, np.ndarray]]] = []
        self.item_of: list[int] = []
        self.unit: list[tuple[int, np.ndarray]] = []
        texts: list[list[str]] = []
        for k, (_, t, w) in enumerate(kept):
            mine = [(min(size, len(x)), shingles(x, size)) for x in (w, *parts_of(t))]
            self.parts.append(mine)
            for x, unit in zip((w, *parts_of(t)), mine):
                if x is w or len(x) >= PART_WORDS:
                    self.item_of.append(k)
                    self.unit.append(unit)
                    texts.append(x)
        df = Counter(x for w in texts for x in set(w))
        n = len(texts)
        mean = sum(map(len, texts)) / max(n, 1)
        idf = {x: math.log(1 + (n - m + 0.5) / (m + 0.5)) for x, m in df.items()}
        frequent = {x for x, m in df.items() if m > max(6, FREQUENT * n)}
        self.rest = np.zeros(n)
        postings: dict[str, list[tuple[int, float]]] = defaultdict(list)
        for k, w in enumerate(texts):
            impact = {x: idf[x] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(w) / mean)) for x, tf in Counter(w).items()}
            most = sorted(impact.values(), reverse=True)
            absent = math.floor(round((1 - similarity) * len(self.unit[k][1]), 9)) if len(w) >= size else 0
            least = sum(most[absent:]) * (1 - 1e-9) or 1e-9
            for x, v in impact.items():
                postings[x].append((k, v / least))
                if x in frequent:
                    self.rest[k] += v / least
        self.terms = {x: n for n, x in enumerate(postings)}
        self.starts = np.cumsum([0, *map(len, postings.values())])
        self.items = np.array([k for p in postings.values() for k, _ in p], np.int32)
        self.impacts = np.array([v for p in postings.values() for _, v in p])
        self.rare = {x: m for x, m in self.terms.items() if x not in frequent}
        #: Units whose frequent terms alone may reach the threshold are admitted with any of their terms.
        loose = set(np.flatnonzero(self.rest >= 1).tolist())
        self.loose = {x for k in loose for x in texts[k]}
        self.unpacked: dict[int, tuple] = {}

    def postings(self, term: int) -> tuple[list[int], list[float], list[tuple[int, float]], float]:
        """Units and impacts of a term, (last unit, largest impact) of each block, and the largest of all."""
        found = self.unpacked.get(term)
        if found is None:
            if len(self.unpacked) >= UNPACKED:
                self.unpacked.clear()
            a, b = self.starts[term], self.starts[term + 1]
            units, impacts = self.items[a:b].tolist(), self.impacts[a:b].tolist()
            blocks = [(units[min(x + POSTING_BLOCK, len(units)) - 1], max(impacts[x : x + POSTING_BLOCK])) for x in range(0, len(units), POSTING_BLOCK)]
            found = self.unpacked[term] = units, impacts, blocks, max(impacts)
        return found

    def admitted(self, found: np.ndarray, term: np.ndarray) -> np.ndarray:
        """Passages (of the rare terms ``term`` found in passages ``found``) that some item may accept."""
        pairs = np.unique(found * len(self.terms) + term)
        passage, term = pairs // len(self.terms), pairs % len(self.terms)
        n = self.starts[term + 1] - self.starts[term]
        at = np.repeat(self.starts[term] - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())
        units = len(self.unit)
        key, inverse = np.unique(np.repeat(passage, n) * units + self.items[at], return_inverse=True)
        total = np.bincount(inverse, weights=self.impacts[at], minlength=len(key)) + self.rest[key % units]
        return np.unique(key[total >= 1] // units)

    def search(self, query: set[str]) -> list[tuple[int, float]]:
        """All units of score 1 or more for the distinct terms of a passage, by block-max WAND."""
        lists = [self.postings(self.terms[x]) for x in query if x in self.terms]
        #: Cursors: the next unit, its place in the list, and the list.
        cursors = [[p[0][0], 0, n] for n, p in enumerate(lists)]
        out = []

        def forward(c: list, to: int) -> None:
            units, _, blocks, _ = lists[c[2]]
            at, block = c[1], c[1] // POSTING_BLOCK
            while block < len(blocks) and blocks[block][0] < to:
                block += 1
                at = block * POSTING_BLOCK
            while at < len(units) and units[at] < to:
                at += 1
            c[0], c[1] = units[at] if at < len(units) else -1, at

        while cursors:
            cursors.sort()
            bound, pivot = 0.0, None
            for at, c in enumerate(cursors):
                bound += lists[c[2]][3]
                if bound >= 1:
                    pivot = at
                    break
            if pivot is None:
                break
            unit = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == unit:
                pivot += 1
            upper, reach = 0.0, None
            for c in cursors[: pivot + 1]:
                blocks, b = lists[c[2]][2], c[1] // POSTING_BLOCK
                while b < len(blocks) and blocks[b][0] < unit:
                    b += 1
                if b < len(blocks):
                    upper += blocks[b][1]
                    reach = blocks[b][0] if reach is None else min(reach, blocks[b][0])
            if upper < 1:  # no unit up to the end of the nearest block can pass
                to = (unit if reach is None else reach) + 1
                if pivot + 1 < len(cursors):
                    to = min(to, max(cursors[pivot + 1][0], unit + 1))
                moved = cursors[: pivot + 1]
            elif cursors[0][0] == unit:
                score = sum(lists[c[2]][1][c[1]] for c in cursors if c[0] == unit)
                if score >= 1:
                    out.append((unit, score))
                to, moved = unit + 1, [c for c in cursors if c[0] == unit]
            else:
                to, moved = unit, [c for c in cursors[:pivot] if c[0] < unit]
            for c in moved:
                forward(c, to)
            cursors = [c for c in cursors if c[0] >= 0]
        return out

    def matches(self, tokens: list[str], passages: list[int]) -> list[tuple]:
        """(item, passage, score, overlap, question, answer) of each item found in the passages of one text."""
        best: dict[int, tuple] = {}
        for p in passages:
            window = tokens[p * self.span : (p + 2) * self.span]
            have: dict[int, np.ndarray] = {}

            def share(unit: tuple[int, np.ndarray]) -> float:
                size, mine = unit
                if size not in have:
                    have[size] = shingles(window, size)
                return len(np.intersect1d(mine, have[size], assume_unique=True)) / len(mine) if size else 0.0

            for unit, score in self.search(set(window)):
                item, held = self.item_of[unit], share(self.unit[unit])
                if held >= self.similarity and (item not in best or held > best[item][0]):
                    best[item] = (held, item, p, score, *map(share, self.parts[item]), *[0.0] * (3 - len(self.parts[item])))
        return [best[k][1:] for k in sorted(best)]

    def scan(self, texts: list[str | None]):
        """For each text its matches; passages are admitted for the whole batch at once."""
        tokens = [words(t) for t in texts]
        out: list[list[tuple]] = [[] for _ in texts]
        if not self.ids:
            return out
        get = self.rare.get
        bases, base, found, term = [], 0, [], []
        for w in tokens:
            bases.append(base)
            ids = np.fromiter((get(x, -1) for x in w), np.int64, len(w))
            at = np.flatnonzero(ids >= 0)
            half = at // self.span
            found += [base + half, (base + half - 1)[half > 0]]
            term += [ids[at], ids[at][half > 0]]
            base += len(w) // self.span + 1
        good = self.admitted(np.concatenate(found), np.concatenate(term)) if found else np.zeros(0, np.int64)
        ends = np.append(np.array(bases, np.int64), base)
        of = np.searchsorted(ends, good, side="right") - 1
        todo: dict[int, list[int]] = defaultdict(list)
        for d, p in zip(of.tolist(), good.tolist()):
            todo[d].append(p - bases[d])
        if self.loose:  # every passage of a text with one of these words may hold such a unit
            for d, w in enumerate(tokens):
                if not self.loose.isdisjoint(w):
                    todo[d] = list(range(len(w) // self.span + 1))
        for d, passages in todo.items():
            out[d] = self.matches(tokens[d], passages)
        return out


def item_blocks(items: DataFrame, id_col: str, text_col: str, index_bytes: int = INDEX_BYTES) -> Iterator[list[tuple]]:
    """The items in blocks whose index has about ``index_bytes``, read one partition after the other."""
    rows = items.select(quoted(id_col).cast("long").alias("i"), quoted(text_col).alias("t")).where("t IS NOT NULL").sort("i", "t")
    block, size, terms = [], 0, set()
    for r in rows.toLocalIterator():
        w = words(r.t)
        size += 80 * len(w) + 160 * len(new := set(w) - terms)  # postings and shingles of two units, and new terms
        terms |= new
        block.append((r.i, r.t))
        if size >= index_bytes:
            yield block
            block, size, terms = [], 0, set()
    if block:
        yield block


def _hits(index):
    def run(batches):
        for batch in batches:
            rows = []
            for doc, found in zip(batch.column(0).to_pylist(), index.value.scan(batch.column(1).to_pylist())):
                rows += [(doc, index.value.ids[m[0]], *m[1:]) for m in found]
            if rows:
                names = ["doc_id", "item_id", "passage", "score", "overlap", "question_overlap", "answer_overlap"]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=names)

    return run


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", index_bytes: int = INDEX_BYTES) -> DataFrame:
    """One row for each document and item that it holds: (doc_id, item_id, passage, score, overlaps)."""
    spark = docs.sparkSession
    bounded_batches(spark)
    kept = docs.select(quoted(id_col).cast("long").alias("doc_id"), quoted(text_col).alias("text"))
    out = spark.createDataFrame([], SCHEMA)
    for n, block in enumerate(item_blocks(items, item_id_col, item_text_col, index_bytes)):
        hits = kept.mapInArrow(_hits(spark.sparkContext.broadcast(Index(block))), SCHEMA)
        out = hits if n == 0 else out.unionByName(hits)
    return out


def _leaks(index):
    @F.pandas_udf("boolean")
    def run(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in series:
            yield pd.Series([bool(m) for m in index.value.scan(texts.tolist())], dtype=bool)

    return run


def clean(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", index_bytes: int = INDEX_BYTES) -> DataFrame:
    """The rows of ``docs`` whose text holds no item; rows pass without a shuffle."""
    spark = docs.sparkSession
    bounded_batches(spark)
    for block in item_blocks(items, item_id_col, item_text_col, index_bytes):
        docs = docs.where(~_leaks(spark.sparkContext.broadcast(Index(block)))(quoted(text_col)))
    return docs
