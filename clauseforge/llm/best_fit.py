"""Best-fit packing whose number of sequences is certified by dual-feasible functions.

A document's ids with an end id are one piece, or, if they are longer than a sequence, whole
sequences and a shorter first piece. Whole sequences are closed at once. The other pieces are packed in
blocks of bounded size by best-fit decreasing. A function f on lengths is dual feasible if the
lengths that fit into a sequence never sum to more than 1 under it; so the sum of f over a block's
pieces is a lower bound of its sequences, and 1 less the sum over one sequence is what that sequence
loses. The best of three families of functions certifies a block: share of the length, share with
lengths near a whole and near none rounded off, and steps of 1/k.

The lengths of all blocks in one histogram give the bound of the whole. While there are more
sequences than it says, sequences that lose more than KEEP_LOSS are opened, with as many of the
finest ones of their block as filling; the documents in them are dealt anew over fewer tasks and
packed again. Rounds end when the bound is met, when nothing was gained, or after ROUNDS.

Ids are made once: each round's pieces are a table in the shared folder, of which open ones are
read again by a filter. A task holds one block. Tables written stay until the caller deletes them.

Edge cases: null and empty texts have the end id alone; equal and repeated rows, and rows without
an id, are packed one by one; an empty table gives no row; other columns are not looked at.
"""

from __future__ import annotations

import uuid
from fractions import Fraction
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clauseforge.llm.byte_bpe import encoder
from clauseforge.llm.common import bounded_batches, quoted
from clauseforge.session import remove, shared_folder

WINDOW = 2048
END_ID = 0
#: Pieces and tokens of a block.
BLOCK_PIECES = 1 << 16
BLOCK_TOKENS = 1 << 24
#: Sequences that lose no more than this share are left closed.
KEEP_LOSS = 1 / 1024
#: Closed sequences of small pieces that are opened for each one that loses.
FILLING = 1
ROUNDS = 4
#: Steps 1/k of the third family.
STEPS = range(1, 33)
FIELDS = "id long, piece int, start long, length long, ids binary, doc_tokens long"
SCHEMA = FIELDS + ", sequence_id long, offset long, open boolean"


# --- bounds -----------------------------------------------------------------------------------


@lru_cache(maxsize=4)
def stepped(window: int) -> list[tuple[int, np.ndarray]]:
    """For each k (unit, values): floor((k + 1) x) / k, but x itself where (k + 1) x is whole; in units of 1 / (k (k + 1))."""
    x = np.arange(window + 1, dtype=np.int64)
    out = []
    for k in STEPS:
        whole, rest = np.divmod((k + 1) * x, window)
        out.append((k * (k + 1), np.where(rest == 0, whole * k, whole * (k + 1))))
    return out


def rounded(window: int, at: int) -> np.ndarray:
    """Lengths over window - at count as a whole, those under ``at`` as none; in units of 1 / window."""
    x = np.arange(window + 1, dtype=np.int64)
    return np.where(x > window - at, window, np.where(x < at, 0, x))


def certificate(histogram: np.ndarray) -> tuple[Fraction, np.ndarray]:
    """The largest bound of sequences for pieces counted by length, and the function (of each length) that gives it."""
    h = np.asarray(histogram, np.int64)
    window = len(h) - 1
    many, tokens = np.cumsum(h), np.cumsum(h * np.arange(window + 1))
    at = np.arange(window // 2 + 1)
    below = np.where(at > 0, tokens[at - 1], 0)
    sums = (many[-1] - many[window - at]) * window + tokens[window - at] - below
    best = int(np.argmax(sums))
    bound, unit, values = Fraction(int(sums[best]), window), window, rounded(window, best)
    for u, f in stepped(window):
        other = Fraction(int(h @ f), u)
        if other > bound:
            bound, unit, values = other, u, f
    return bound, values / unit


def ceil(x: Fraction) -> int:
    return -(-x.numerator // x.denominator)


# --- packing ----------------------------------------------------------------------------------


def best_fit(lengths: list[int], window: int = WINDOW) -> list[list[int]]:
    """Sequences as lists of positions in ``lengths``: longest first, each into the fullest sequence that takes it.

    Open sequences are listed by the room they have; the least sufficient room is the lowest bit of a mask.
    """
    by_room: list[list[int]] = [[] for _ in range(window + 1)]
    rooms, out = 0, []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        n = lengths[i]
        fits = rooms >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            at = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
        else:
            at, room = len(out), window
            out.append([])
        out[at].append(i)
        if room > n:
            by_room[room - n].append(at)
            rooms |= 1 << (room - n)
    return out


def opened(sequences: list[list[int]], lengths: list[int], window: int, keep_loss: float = KEEP_LOSS) -> list[bool]:
    """Which sequences lose by the block's own certificate, and the finest others that go with them."""
    _, f = certificate(np.bincount(lengths, minlength=window + 1))
    loss = [1 - sum(f[lengths[i]] for i in s) for s in sequences]
    out = [x > keep_loss for x in loss]
    closed = sorted((k for k, x in enumerate(out) if not x), key=lambda k: -len(sequences[k]))
    for k in closed[: FILLING * sum(out)]:
        out[k] = True
    return out


class Packer:
    """Pieces in, rows of packed sequences out, a block at a time."""

    def __init__(self, base: int, window: int, pieces: int = BLOCK_PIECES, tokens: int = BLOCK_TOKENS):
        self.next, self.window, self.max_pieces, self.max_tokens = base, window, pieces, tokens
        self.held: list[tuple] = []
        self.tokens = 0
        self.rows: list[tuple] = []

    def close(self, pieces: list[tuple], is_open: bool) -> None:
        offset = 0
        for p in pieces:
            self.rows.append((*p, self.next, offset, is_open))
            offset += p[3]
        self.next += 1

    def add(self, piece: tuple) -> None:
        if piece[3] == self.window:
            self.close([piece], False)
            return
        self.held.append(piece)
        self.tokens += piece[3]
        if len(self.held) >= self.max_pieces or self.tokens >= self.max_tokens:
            self.pack()

    def pack(self) -> None:
        held, self.held, self.tokens = self.held, [], 0
        lengths = [p[3] for p in held]
        sequences = best_fit(lengths, self.window)
        for s, is_open in zip(sequences, opened(sequences, lengths, self.window)):
            self.close([held[i] for i in s], is_open)

    def take(self):
        rows, self.rows = self.rows, []
        names = [f.split()[0] for f in SCHEMA.split(", ")]
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
        for a in range(0, len(rows), 1 << 12):
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows[a : a + (1 << 12)]), kinds)], names=names)


def cut(doc_id, ids: np.ndarray, window: int):
    """Pieces of one document: what is left over comes first, then whole sequences."""
    n, ids = len(ids), ids.astype("<u4")
    ends = range(n % window or window, n + 1, window)
    for k, end in enumerate(ends):
        start = ends[k - 1] if k else 0
        yield doc_id, k, start, end - start, ids[start:end].tobytes(), n


def _base(round_: int) -> int:
    """First number of this task's sequences."""
    return round_ << 58 | TaskContext.get().partitionId() << 32


def _first(path: str, end_id: int, window: int):
    def run(batches):
        enc, packer = encoder(path), Packer(_base(0), window)
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for piece in cut(doc_id, np.append(enc.encode(text), np.uint32(end_id)), window):
                    packer.add(piece)
            yield from packer.take()
        packer.pack()
        yield from packer.take()

    return run


def _again(round_: int, window: int):
    def run(batches):
        packer = Packer(_base(round_), window)
        for batch in batches:
            for piece in zip(*(c.to_pylist() for c in batch.columns)):
                packer.add(piece)
            yield from packer.take()
        packer.pack()
        yield from packer.take()

    return run


def _sequences(rows: DataFrame) -> int:
    return rows.where("offset = 0").count()


def pack_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, window: int = WINDOW, rounds: int = ROUNDS) -> DataFrame:
    """One row per piece: (id, piece, start, length, ids, doc_tokens, sequence_id, offset).

    ``ids`` holds the piece's ids as little-endian unsigned 32-bit integers.
    """
    return certified(docs, path, id_col, text_col, end_id, window, rounds)[0]


def certified(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, window: int = WINDOW, rounds: int = ROUNDS) -> tuple[DataFrame, list[tuple[int, int]]]:
    """The pieces, and after each round (sequences, bound), whole sequences left out on both sides."""
    spark = docs.sparkSession
    bounded_batches(spark)
    place = f"{shared_folder(spark)}/best-fit-{uuid.uuid4().hex}"

    def written(rows: DataFrame, n: int) -> DataFrame:
        rows.write.parquet(f"{place}/{n}")
        return spark.read.parquet(f"{place}/{n}")

    kept = docs.select(quoted(id_col).cast("long").alias("id"), quoted(text_col).alias("text"))
    now = written(kept.mapInArrow(_first(path, end_id, window), SCHEMA), 0)
    # One row a length, of which there are fewer than ``window``.
    histogram = np.zeros(window + 1, np.int64)
    for r in now.where(F.col("length") < window).groupBy("length").count().collect():
        histogram[r["length"]] = r["count"]
    bound = ceil(certificate(histogram)[0])
    closed = [now.where("not open")]
    done = _sequences(closed[0].where(F.col("length") < window))
    ahead = _sequences(now.where("open"))
    figures = [(done + ahead, bound)]
    for round_ in range(1, rounds + 1):
        if done + ahead <= bound:
            break
        pool = now.where("open").select("id", "piece", "start", "length", "ids", "doc_tokens", "sequence_id", "offset")
        size = pool.agg(F.count("*").alias("n"), F.sum("length").alias("tokens")).first()
        tasks = max(-(-size["n"] // BLOCK_PIECES), -(-size["tokens"] // BLOCK_TOKENS))
        dealt = pool.repartition(tasks, F.xxhash64("sequence_id", "offset")).sortWithinPartitions(F.xxhash64("offset", "sequence_id")).drop("sequence_id", "offset")
        new = written(dealt.mapInArrow(_again(round_, window), SCHEMA), round_)
        settled, left = _sequences(new.where("not open")), _sequences(new.where("open"))
        if settled + left >= ahead:
            remove(spark, f"{place}/{round_}")
            break
        now, done, ahead = new, done + settled, left
        closed.append(now.where("not open"))
        figures.append((done + ahead, bound))
    rows = now.where("open")
    for part in closed:
        rows = rows.unionByName(part)
    return rows.drop("open").withColumnRenamed("id", id_col), figures
