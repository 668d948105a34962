"""Postings in blocks of neighbouring chunks, and BM25 over them without a shuffle of postings.

A row holds all postings of BLOCK chunks, by term. A task sums the scores of its blocks' chunks, so
what leaves it is the best ``k`` of each question, however many chunks share a word with it. The
largest gain of each term in a block bounds what any of its chunks can score; questions whose bound
lies below the k-th best score that the task has found so far skip the block.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 128
SCHEMA = "block long, terms array<string>, sizes binary, docs binary, tf binary, dl binary"
NAMES = ["block", "terms", "sizes", "docs", "tf", "dl"]
#: Candidates of one task that are held before the best are picked.
HELD = 1 << 20
#: Sums of one table: questions by chunks.
CELLS = 1 << 21


def _row(block: int, term: pa.Array, pos: np.ndarray, tf: np.ndarray, dl: np.ndarray) -> pa.RecordBatch:
    runs = pc.run_end_encode(term)
    sizes = np.diff(runs.run_ends.to_numpy(), prepend=0).astype(np.int32)
    docs = (pos - block * BLOCK).astype(np.uint8)
    lengths = np.zeros(BLOCK, np.int64)
    lengths[docs] = dl
    values = runs.values
    terms = pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
    cells = [pa.array([x.tobytes()]) for x in (sizes, docs, tf.astype(np.uint32), lengths)]
    return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), terms, *cells], names=NAMES)


def _packed(batches):
    """Rows (block, term, pos, tf, dl) in order to one row a block."""
    held: list[pa.RecordBatch] = []
    now = None

    def closed():
        t = pa.Table.from_batches(held).combine_chunks()
        column = lambda name: t[name].combine_chunks()
        term = column("term")
        return _row(now, term if isinstance(term, pa.Array) else term.chunk(0), *(t[c].to_numpy() for c in ("pos", "tf", "dl")))

    for batch in batches:
        block = batch.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(block)]
        for a, z in zip(cuts, cuts[1:]):
            if a == z:
                continue
            if held and block[a] != now:
                yield closed()
                held = []
            now = int(block[a])
            held.append(batch.slice(a, z - a))
    if held:
        yield closed()


def blocked(postings: DataFrame) -> DataFrame:
    """One row for each BLOCK neighbouring positions that have postings (pos, dl, term, tf)."""
    rows = postings.select(F.floor(F.col("pos") / BLOCK).alias("block"), "term", "pos", "tf", "dl")
    return rows.repartitionByRange("block").sortWithinPartitions("block", "term", "pos").mapInArrow(_packed, SCHEMA)


PIECES = "block long, terms array<string>, sizes binary, pos binary, tf binary, dl binary"


def _pieces(parts):
    """Batches of chunks (pos, dl, terms, sizes, docs, tf) -> one row for each block that a batch has chunks of."""
    for part in parts:
        for i in range(part.num_rows):
            read = lambda name, kind: np.frombuffer(part[name][i].as_py(), kind)  # noqa: B023,E731
            docs, tf, pos, dl, sizes = (read(*x) for x in (("docs", np.int32), ("tf", np.uint32), ("pos", np.int64), ("dl", np.int64), ("sizes", np.int32)))
            term, block = np.repeat(np.arange(len(sizes)), sizes), pos[docs] // BLOCK
            order = np.argsort(block, kind="stable")  # terms stay together
            cuts = [0, *(np.flatnonzero(np.diff(block[order])) + 1).tolist(), len(order)]
            for a, z in zip(cuts, cuts[1:]):
                if a == z:
                    continue
                at = order[a:z]
                first = np.flatnonzero(np.diff(term[at], prepend=-1))
                terms = part["terms"][i].values.take(pa.array(term[at][first]))
                cells = (np.diff(np.append(first, len(at))).astype(np.int32), pos[docs[at]], tf[at], dl[docs[at]])
                yield pa.RecordBatch.from_arrays([pa.array([int(block[at[0]])], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(terms)], pa.int32()), terms), *(pa.array([x.tobytes()]) for x in cells)], names=["block", "terms", "sizes", "pos", "tf", "dl"])


def _merged(parts):
    """Rows of PIECES in order of blocks to one row a block."""
    now, held = None, []

    def closed():
        term = pa.concat_arrays([t.take(pa.array(np.repeat(np.arange(len(t)), n))) for t, n, *_ in held])
        pos, tf, dl = (np.concatenate(c) for c in list(zip(*held))[2:])
        order = pc.sort_indices(pa.table({"term": term, "pos": pos}), sort_keys=[("term", "ascending"), ("pos", "ascending")])
        at = order.to_numpy()
        return _row(now, term.take(order), pos[at], tf[at], dl[at])

    for part in parts:
        for i in range(part.num_rows):
            block = part["block"][i].as_py()
            if held and block != now:
                yield closed()
                held = []
            now = block
            held.append((part["terms"][i].values, *(np.frombuffer(part[name][i].as_py(), kind) for name, kind in (("sizes", np.int32), ("pos", np.int64), ("tf", np.uint32), ("dl", np.int64)))))
    if held:
        yield closed()


def of_batches(batches: DataFrame) -> DataFrame:
    """``blocked`` of the postings of batches; a term is sent once a block and batch instead of each posting."""
    pieces = batches.select("pos", "dl", "terms", "sizes", "docs", "tf").mapInArrow(_pieces, PIECES)
    return pieces.repartition("block").sortWithinPartitions("block").mapInArrow(_merged, SCHEMA)


def total_length(blocks: DataFrame) -> DataFrame:
    """(total): the summed lengths of all chunks, one row."""

    def sums(batches):
        yield pa.RecordBatch.from_arrays([pa.array([sum(int(np.frombuffer(x, np.int64).sum()) for b in batches for x in b.column(0).to_pylist())], pa.int64())], names=["total"])

    return blocks.select("dl").mapInArrow(sums, "total long").agg(F.sum("total").alias("total"))


class Asked:
    """Weights of terms by question: for each term the questions that have it, one after the other."""

    def __init__(self, rows: pa.Table):
        rows = rows.sort_by("term")
        terms = rows["term"].combine_chunks()
        runs = pc.run_end_encode(terms if isinstance(terms, pa.Array) else terms.chunk(0))
        ids = pa.chunked_array([rows["qid"].unique()]).combine_chunks().sort()
        self.ids = ids
        self.terms = runs.values
        self.ends = np.concatenate([[0], runs.run_ends.to_numpy()]).astype(np.int64)
        self.question = pc.index_in(rows["qid"], value_set=ids).to_numpy().astype(np.int64)
        self.weight = rows["weight"].to_numpy().astype(np.float64)


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The positions starts[i] .. starts[i] + sizes[i] - 1, one after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)


def scores(asked: Asked, terms: pa.Array, sizes: np.ndarray, docs: np.ndarray, gain, n: int, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(question, doc, score) of ``n`` chunks, for the questions that can reach their ``least`` score.

    ``docs`` are the chunks of the postings, ``sizes`` of each of the ``terms``; ``gain`` gives what the
    postings at given places count.
    """
    none = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    met = pc.index_in(terms, value_set=asked.terms)
    here = np.flatnonzero(met.is_valid().to_numpy(zero_copy_only=False))
    if not len(here):
        return none
    of = met.drop_null().to_numpy().astype(np.int64)
    sizes = sizes.astype(np.int64)
    starts = (np.cumsum(sizes) - sizes)[here]
    sizes = sizes[here]
    at = spread(starts, sizes)
    docs, gain = docs[at].astype(np.int64), gain(at)
    first = np.cumsum(sizes) - sizes
    top = np.maximum.reduceat(gain, first)
    # One entry for each question that has a term of the block.
    many = asked.ends[of + 1] - asked.ends[of]
    entry = spread(asked.ends[of], many)
    question, weight, term = asked.question[entry], asked.weight[entry], np.repeat(np.arange(len(of)), many)
    bound = np.bincount(question, weight * top[term], len(least))
    live = (bound + 1e-8 >= least)[question]
    question, weight, term = question[live], weight[live], term[live]
    if not len(question):
        return none
    out = []
    order = np.argsort(question, kind="stable")
    question, weight, term = question[order], weight[order], term[order]
    # So many questions at once as keep the table of sums small.
    ends = np.cumsum(np.bincount(question, minlength=len(least)))
    step = max(1, CELLS // n)
    for q in range(0, len(least), step):
        a, z = ends[q - 1] if q else 0, ends[min(q + step, len(least)) - 1]
        if a == z:
            continue
        each = spread(first[term[a:z]], sizes[term[a:z]])
        cell = np.repeat(question[a:z] - q, sizes[term[a:z]]) * n + docs[each]
        sums = np.bincount(cell, np.repeat(weight[a:z], sizes[term[a:z]]) * gain[each])
        found = np.flatnonzero(sums)
        out.append((found // n + q, found % n, sums[found]))
    return tuple(np.concatenate(x) for x in zip(*out))


def block_scores(asked: Asked, row: dict, avgdl: float, k1: float, b: float, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(question, position, score) of a block's chunks, for the questions that can reach their ``least`` score."""
    docs, tf = np.frombuffer(row["docs"], np.uint8), np.frombuffer(row["tf"], np.uint32)
    norm = k1 * (1 - b + b * np.frombuffer(row["dl"], np.int64) / avgdl)
    gain = lambda at: tf[at] * (k1 + 1) / (tf[at] + norm[docs[at]])
    question, doc, score = scores(asked, row["terms"], np.frombuffer(row["sizes"], np.int32), docs, gain, BLOCK, least)
    return question, doc + row["block"] * BLOCK, score


def best(question: np.ndarray, pos: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Indices of the first ``k`` of each question: by score rounded to nine places, then by position."""
    order = np.lexsort((pos, -np.round(score, 9), question))
    q = question[order]
    new = np.flatnonzero(np.append(True, q[1:] != q[:-1])) if len(q) else np.zeros(0, np.int64)
    place = np.arange(len(q)) - np.repeat(new, np.diff(np.append(new, len(q))))
    return order[place < k]


class Best:
    """The best ``k`` of each question among candidates that come in parts; ``least`` is what a new one has to reach."""

    def __init__(self, questions: int, k: int):
        self.k, self.least = k, np.full(questions, -np.inf)
        self.kept: list[tuple] = []
        self.n = 0

    def add(self, question: np.ndarray, pos: np.ndarray, score: np.ndarray) -> None:
        good = np.round(score, 9) >= self.least[question]
        self.kept.append((question[good], pos[good], score[good]))
        self.n += int(good.sum())
        if self.n > 2 * self.k * len(self.least) and (self.n > HELD or np.isinf(self.least).any()):
            self.pick()

    def pick(self) -> None:
        question, pos, score = (np.concatenate(c) for c in zip(*self.kept))
        at = best(question, pos, score, self.k)
        question, pos, score = question[at], pos[at], score[at]
        full = np.bincount(question, minlength=len(self.least)) >= self.k
        low = np.full(len(self.least), np.inf)
        np.minimum.at(low, question, np.round(score, 9))
        self.least[full] = low[full]
        self.kept, self.n = [(question, pos, score)], len(question)

    def rows(self, ids: pa.Array):
        """Batches (qid, pos, score) of what is left."""
        if self.kept:
            self.pick()
            question, pos, score = self.kept[0]
            for a in range(0, len(question), 1 << 16):
                z = slice(a, a + (1 << 16))
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(question[z])), pa.array(pos[z]), pa.array(score[z])], names=["qid", "pos", "score"])


def search(blocks: DataFrame, asked: DataFrame, avgdl: float, k: int, k1: float, b: float) -> DataFrame:
    """(qid, pos, score): of each task's chunks the best ``k`` of each question, for ``asked`` (qid, term, weight).

    ``asked`` is a query set whose size the caller has checked.
    """
    spark, kind = blocks.sparkSession, asked.schema["qid"].dataType.simpleString()
    table = asked.select("qid", "term", "weight").toArrow()
    schema = f"qid {kind}, pos long, score double"
    if not table.num_rows:
        return spark.createDataFrame([], schema)
    held = spark.sparkContext.broadcast(Asked(table))

    def run(batches):
        asked = held.value
        found = Best(len(asked.ids), k)
        for batch in batches:
            terms = batch.column(1)
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i].as_py() for name in NAMES if name != "terms"} | {"terms": terms[i].values}
                found.add(*block_scores(asked, row, avgdl, k1, b, found.least))
        yield from found.rows(asked.ids)

    return blocks.select(*NAMES).mapInArrow(run, schema)
