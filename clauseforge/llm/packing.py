"""Hierarchical packing of token sequences into windows of several context sizes.

Every document's ids plus an end id are routed by length: whole long windows leave at once,
the rest goes to the smallest tier that holds it. Tiers are packed from the longest down; the
gap of a window is filled with the longest pieces of shorter tiers that fit, and what is then
still open with a cut of one more piece, so that windows are full. Windows are powers of two,
which need no padding. Windows of one tier form step groups of equal token counts; what is left of
all tiers at the end of a task is put together, largest first, so that one group of a task at most
is short.

A partition is packed on its own, in one streaming pass without a shuffle, so the work and
memory of a task do not depend on the size of the input. What is left at its end is less than one
window of the longest tier. These remainders alone are shuffled and packed together, REMAINDERS to
a task, as often as it takes to leave one; only that goes into ever smaller powers of two.
Each pass is written to the shared folder, so a lost task gives the same rows again and no text is
encoded twice; the tables that the result is read from stay there.

Edge cases: null and empty texts have the end id alone; equal and repeated rows are packed one
by one; an empty table gives no row; other columns of the input are not looked at.
"""

from __future__ import annotations

import uuid
from bisect import bisect_right, insort

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clauseforge.llm.bpe import encoder
from clauseforge.llm.common import bounded_batches, quoted, shared_folder

TIERS = (4096, 2048, 1024, 512, 256)
END_ID = 2
#: Windows of one step group hold this many tokens together.
STEP_TOKENS = 32 * 4096
#: Pieces that wait for a window before tiers are packed.
POOL = 4096
#: What so many tasks have left is packed by one task.
REMAINDERS = 1024
SCHEMA = "id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, window long, step_group long"


class Packer:
    """Pieces are (length, number, start) with ids held by number; closed windows go to ``rows``."""

    def __init__(self, partition: int, tiers=TIERS, pool: int = POOL, step_tokens: int = STEP_TOKENS):
        self.tiers, self.pool, self.step_tokens = tuple(sorted(tiers, reverse=True)), pool, step_tokens
        self.base, self.sequences, self.serial = partition << 32, 0, 0
        self.docs: dict[int, list] = {}
        self.waiting: list[tuple[int, int, int]] = []
        #: By tier the windows (rows without their group) of the step group that is filling.
        self.steps: dict[int, list[list[tuple]]] = {}
        self.groups = 0
        self.rows: list[tuple] = []

    def add(self, doc_id, ids: bytes, first: int = 0, total: int | None = None) -> None:
        """Ids of a document of ``total`` tokens, which ``first`` others precede."""
        n, top = len(ids) // 4, self.tiers[0]
        self.serial += 1
        whole = n - n % top
        self.docs[self.serial] = [doc_id, ids, n if total is None else total, n, first]
        for start in range(0, whole, top):
            self.close(top, [(top, self.serial, start)])
        if whole < n:
            self.waiting.append((n - whole, self.serial, whole))
        if len(self.waiting) >= self.pool:
            self.pack()

    def close(self, window: int, pieces: list[tuple[int, int, int]]) -> None:
        rows = self.placed(window, pieces)
        held = self.steps.setdefault(window, [])
        held.append(rows)
        if len(held) * window >= self.step_tokens:
            self.emit(self.steps.pop(window))

    def placed(self, window: int, pieces: list[tuple[int, int, int]]) -> list[tuple]:
        """The rows, without their group, of the next sequence."""
        sequence, offset, rows = self.base + self.sequences, 0, []
        self.sequences += 1
        for length, serial, start in pieces:
            doc = self.docs[serial]
            rows.append((doc[0], doc[4] + start, length, doc[1][4 * start : 4 * (start + length)], doc[2], sequence, offset, window))
            offset += length
            doc[3] -= length
            if not doc[3]:
                del self.docs[serial]
        return rows

    def emit(self, windows: list[list[tuple]]) -> None:
        """The rows of one step group."""
        self.rows += [(*row, self.base + self.groups) for rows in windows for row in rows]
        self.groups += 1

    def balance(self) -> None:
        """What is left of all tiers as groups of equal token counts; powers of two leave no gap but in the last."""
        group, held = [], 0
        for window in sorted(self.steps, reverse=True):
            for rows in self.steps[window]:
                if held + window > self.step_tokens and group:
                    self.emit(group)
                    group, held = [], 0
                group.append(rows)
                held += window
        if group:
            self.emit(group)
        self.steps = {}

    def pack(self, last: bool = False) -> None:
        pool, self.waiting = sorted(self.waiting), []
        window_of = lambda n: next(t for t in reversed(self.tiers) if t >= n)
        while pool:
            first = pool.pop()
            window, pieces = window_of(first[0]), [first]
            gap = window - first[0]
            while gap and pool:
                at = bisect_right(pool, (gap, float("inf"), 0)) - 1
                if at >= 0:
                    piece = pool.pop(at)
                else:  # every piece is longer than the gap: cut the shortest
                    length, serial, start = pool.pop(0)
                    piece = (gap, serial, start)
                    insort(pool, (length - gap, serial, start + gap))
                pieces.append(piece)
                gap -= piece[0]
            if not gap:
                self.close(window, pieces)
            elif last:
                self.finish(pieces)
            else:
                self.waiting = pieces

    def finish(self, pieces: list[tuple[int, int, int]]) -> None:
        """The last pieces of all, cut at powers of two."""
        left = sum(p[0] for p in pieces)
        while left:
            window = 1 << (left.bit_length() - 1)
            now, need = [], window
            while need:
                length, serial, start = pieces.pop(0)
                take = min(length, need)
                now.append((take, serial, start))
                if take < length:
                    pieces.insert(0, (length - take, serial, start + take))
                need -= take
            self.close(window, now)
            left -= window

    def leave(self) -> None:
        """Pack what waits; pieces that fill no window become rows of window and group 0, for another task."""
        self.pack()
        pieces, self.waiting = self.waiting, []
        self.rows += [(*row, 0) for row in self.placed(0, pieces)]

    def take(self) -> list[tuple]:
        rows, self.rows = self.rows, []
        return rows


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = ["id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "window", "step_group"]
    kinds = [pa.int64()] * 3 + [pa.binary()] + [pa.int64()] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


def _packer(level: int, tiers, step_tokens: int) -> Packer:
    return Packer(level << 26 | TaskContext.get().partitionId(), tiers, step_tokens=step_tokens)


def _end(packer: Packer, last: bool = False):
    if last:
        packer.pack(last=True)
    else:
        packer.leave()
    packer.balance()
    if rows := packer.take():
        yield _batch(rows)


def pack_partition(path: str, end_id: int = END_ID, tiers=TIERS, step_tokens: int = STEP_TOKENS):
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        enc, packer = encoder(path), _packer(0, tiers, step_tokens)
        for batch in batches:
            for doc_id, ids in zip(batch.column(0).to_pylist(), enc.encode(batch.column(1).to_pylist())):
                packer.add(doc_id, ids + end)
            if rows := packer.take():
                yield _batch(rows)
        yield from _end(packer)

    return run


def pack_remainders(level: int, last: bool, tiers=TIERS, step_tokens: int = STEP_TOKENS):
    def run(batches):
        packer = _packer(level, tiers, step_tokens)
        for batch in batches:
            for doc_id, start, ids, total in zip(*(c.to_pylist() for c in batch.columns)):
                packer.add(doc_id, ids, start, total)
            if rows := packer.take():
                yield _batch(rows)
        yield from _end(packer, last)

    return run


def pack_documents(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, tiers=TIERS, step_tokens: int = STEP_TOKENS, remainders: int = REMAINDERS
) -> DataFrame:
    """One row per piece: (id, start, length, ids, doc_tokens, sequence_id, offset, window, step_group).

    ``ids`` holds the piece's ids as little-endian unsigned 32-bit integers.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    place = f"{shared_folder(spark)}/packing-{uuid.uuid4().hex}"

    def written(rows: DataFrame, level: int) -> DataFrame:
        rows.write.parquet(f"{place}/{level}")
        return spark.read.schema(SCHEMA).parquet(f"{place}/{level}")

    kept = docs.select(quoted(id_col).cast("long").alias("id"), quoted(text_col).alias("text"))
    now, level = written(kept.mapInArrow(pack_partition(path, end_id, tiers, step_tokens), SCHEMA), 0), 0
    out = now.where("window > 0")
    while n := now.where("window = 0").select("sequence_id").distinct().count():
        tasks, level = -(-n // remainders), level + 1
        dealt = now.where("window = 0").repartition(tasks, F.xxhash64("sequence_id")).sortWithinPartitions("sequence_id", "offset")
        packed = dealt.select("id", "start", "ids", "doc_tokens").mapInArrow(pack_remainders(level, tasks == 1, tiers, step_tokens), SCHEMA)
        now = written(packed, level)
        out = out.unionByName(now.where("window > 0"))
    return out.withColumnRenamed("id", id_col)
