"""Latent vectors: a truncated decomposition of TF-IDF rows over the kept terms, by a range finder.

The columns are the kept terms, up to MAX_COLUMNS; a larger vocabulary shares that many columns by
signed hashes. From a block of random columns the range finder takes products with A^T A (A: one row
a chunk), each made orthonormal to all before, until the blocks are WIDTH times as wide as the
vectors wanted; a small eigenvalue problem on their span gives the leading right singular vectors.
Keeping all blocks, not the last alone, finds them where singular values fall slowly.

A product is one pass over the rows: a task has the block, adds up its part in double precision, and
sends the rows that it has met, which a second step sums. What reaches the driver is one block of
MAX_COLUMNS rows, whatever the number of chunks, and it holds WIDTH * dims of such columns in single
precision; rows themselves are never shuffled after they are made.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clauseforge.functions import text as T
from clauseforge.operators import batches
from clauseforge.session import settled

MAX_COLUMNS = 1 << 17
#: Columns of one block, and how much wider than the vectors wanted all blocks are.
SLICE = 96
WIDTH = 3
#: Rows of X in one block that is sent.
BLOCK = 1024
#: Entries of rows that are multiplied at once.
ENTRIES = 1 << 15


def slot(limit: int, term="term"):
    return F.pmod(F.xxhash64(term), F.lit(limit)).cast("int")


def sign(term="term"):
    return F.when(F.pmod(F.xxhash64(term, F.lit(0)), F.lit(2)) == 0, 1.0).otherwise(-1.0)


def columns(weights: DataFrame | None, limit: int = MAX_COLUMNS, terms: DataFrame | None = None) -> DataFrame | None:
    """(term, f): a column for each term, the most frequent first; None if there are more than ``limit``.

    ``terms`` (term, df) are those of the weights, if they are known.
    """
    terms = weights.groupBy("term").agg(F.count("*").alias("df")) if terms is None else terms
    if terms.limit(limit + 1).count() > limit:
        return None
    order = Window.orderBy(F.desc("df"), "term")  # at most ``limit`` rows
    return settled(terms.select("term", (F.row_number().over(order) - 1).alias("f")))


def entries(weights: DataFrame, of: DataFrame | None, limit: int = MAX_COLUMNS, key: str = "pos") -> DataFrame:
    """(key, r): the entries (f, w) of each row."""
    if of is None:
        rows = weights.select(key, slot(limit).alias("f"), (sign() * F.col("w")).alias("w")).groupBy(key, "f").agg(F.sum("w").alias("w"))
    else:
        rows = weights.join(F.broadcast(of), "term").select(key, "f", "w")
    return rows.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("f", "w"))).alias("r"))  # a row's own terms


def _chunks(column):
    """Parts of a batch of entry lists with about ENTRIES entries: (first row, columns, weights, starts of rows)."""
    flat, ends = column.flatten(), np.cumsum([0, *column.value_lengths().to_numpy(zero_copy_only=False)])
    f, w = flat.field("f").to_numpy(), flat.field("w").to_numpy()
    first = 0
    while first < len(ends) - 1:
        last = max(first + 1, int(np.searchsorted(ends, ends[first] + ENTRIES, side="right")) - 1)
        a, b = ends[first], ends[last]
        yield first, f[a:b], w[a:b], ends[first:last] - a
        first = last


def times(rows: DataFrame, x: np.ndarray) -> np.ndarray:
    """A^T A x over the rows (r)."""
    m, s = x.shape
    spark = rows.sparkSession
    held = spark.sparkContext.broadcast(np.ascontiguousarray(x, np.float32))

    def blocks(at, values):
        for b in np.unique(at // BLOCK):
            a, z = np.searchsorted(at, [b * BLOCK, (b + 1) * BLOCK])
            yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([at[a:z].astype(np.int32).tobytes()]), pa.array([values[at[a:z]].astype(np.float32).tobytes()])], names=["b", "at", "v"])

    def products(batches):
        table, total, met = held.value, None, np.zeros(m, bool)
        for batch in batches:
            for _, f, w, starts in _chunks(batch.column(0)):
                if total is None:
                    total = np.zeros((m, s))
                y = np.add.reduceat(table[f] * w[:, None].astype(np.float32), starts, axis=0)  # one sum a row and column
                order = np.argsort(f, kind="stable")
                of = np.repeat(np.arange(len(starts)), np.diff([*starts, len(f)]))[order]
                at, first = np.unique(f[order], return_index=True)
                total[at] += np.add.reduceat(y[of] * w[order, None].astype(np.float32), first, axis=0)
                met[at] = True
        if total is not None:
            yield from blocks(np.flatnonzero(met), total)

    def summed(batches):
        total: dict = {}
        for batch in batches:
            for b, at, v in zip(*(c.to_pylist() for c in batch.columns)):
                mine = total.setdefault(b, np.zeros((BLOCK, s)))
                mine[np.frombuffer(at, np.int32) - b * BLOCK] += np.frombuffer(v, np.float32).reshape(-1, s)
        for b, v in total.items():
            at = np.flatnonzero(v.any(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([(at + b * BLOCK).astype(np.int32).tobytes()]), pa.array([v[at].astype(np.float32).tobytes()])], names=["b", "at", "v"])

    schema = "b int, at binary, v binary"
    found = rows.select("r").mapInArrow(products, schema).repartition("b").mapInArrow(summed, schema).toArrow()
    out = np.zeros((m, s), np.float32)
    for at, v in zip(found["at"].to_pylist(), found["v"].to_pylist()):
        out[np.frombuffer(at, np.int32)] = np.frombuffer(v, np.float32).reshape(-1, s)
    held.destroy()
    return out


def orthonormal(z: np.ndarray, least: float = 0.0) -> np.ndarray:
    """A basis of the span of the columns; directions no longer than ``least`` are dropped. Twice, as rounding asks."""
    for k in range(2):
        if not z.shape[1]:
            break
        values, vectors = np.linalg.eigh((z.T @ z).astype(np.float64))
        good = values > max(1e-13 * float(values[-1]), 0.0 if k else least**2)
        z = z @ (vectors[:, good] / np.sqrt(values[good])).astype(z.dtype)
    return z


def leading(rows: DataFrame, m: int, dims: int, width: int = WIDTH, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The first ``dims`` right singular vectors of the rows over ``m`` columns, and their singular values, zeros at the end."""
    x = orthonormal(np.random.default_rng(seed).standard_normal((m, min(m, SLICE))))
    blocks: list[np.ndarray] = []
    small = np.zeros((0, 0))
    while x.shape[1]:
        blocks.append(x.astype(np.float32))
        z = times(rows, blocks[-1])
        side = np.vstack([b.T @ z for b in blocks])
        small = np.block([[small, side[: len(small)]], [side[: len(small)].T, side[len(small) :]]])
        if len(small) >= width * dims:
            break
        for _ in range(2):
            for b in blocks:
                z -= b @ (b.T @ z)
        x = orthonormal(z, 1e-5 * np.linalg.norm(small, 2))
    values, vectors = np.linalg.eigh((small + small.T) / 2)
    order = np.argsort(values)[::-1][:dims]
    order = order[values[order] > 1e-6 * max(float(values.max(initial=0)), 1e-300)]
    basis, sigma = np.zeros((m, dims), np.float32), np.zeros(dims)
    sigma[: len(order)] = np.sqrt(values[order])
    for at, b in zip(np.cumsum([0, *(b.shape[1] for b in blocks)]), blocks):
        basis[:, : len(order)] += b @ vectors[at : at + b.shape[1], order].astype(np.float32)
    return basis, sigma


def project(rows: DataFrame, basis: np.ndarray, key: str = "pos") -> DataFrame:
    """(key, vector) of the rows (key, r) on a basis, of unit length."""
    held = rows.sparkSession.sparkContext.broadcast(np.ascontiguousarray(basis, np.float32))

    def run(batches):
        for batch in batches:
            for first, f, w, starts in _chunks(batch.column(1)):
                out = np.add.reduceat(held.value[f] * w[:, None], starts, axis=0)
                out /= np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)
                n, k = out.shape
                vectors = pa.ListArray.from_arrays(np.arange(0, (n + 1) * k, k, dtype=np.int32)[: n + 1], pa.array(out.reshape(-1)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, n), vectors], names=[key, "vector"])

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, "r").mapInArrow(run, f"{key} {kind}, vector array<double>")


def latent_vectors(weights: DataFrame, dims: int = 256, limit: int = MAX_COLUMNS, width: int = WIDTH, seed: int = 0, terms: DataFrame | None = None, weighed: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(pos, vector) of unit length from TF-IDF rows (pos, term, w), and the basis (f, term, row).

    There are as many dimensions as asked for, but fewer than chunks and columns, two at least; those
    without a singular value are zero. In the basis a term is null where columns are hashes. With the kept
    ``terms`` (term, df) and the ``weighed`` batches that the weights are of, rows are made without a shuffle.
    """
    spark = weights.sparkSession
    of = columns(weights, limit, terms)
    if weighed is None:
        made = entries(weights, of, limit)
    else:
        names = None if of is None else of.sort("f").select("term").toArrow()["term"].combine_chunks()
        made = batches.entries(weighed, limit, names, lambda t: slot(limit, t), sign)
    rows = settled(made)
    m = limit if of is None else of.count()
    if not m:
        return spark.createDataFrame([], "pos long, vector array<double>"), spark.createDataFrame([], "f int, term string, row array<float>")
    found, _ = leading(rows, m, min(dims, max(2, min(rows.count(), m) - 1)), width, seed)
    k = found.shape[1]
    made = pa.ListArray.from_arrays(np.arange(0, (m + 1) * k, k, dtype=np.int32)[: m + 1], pa.array(found.astype(np.float32).reshape(-1)))
    basis = spark.createDataFrame(pa.table({"f": pa.array(np.arange(m, dtype=np.int32)), "row": made}))
    named = basis.withColumn("term", F.lit(None).cast("string")) if of is None else basis.join(F.broadcast(of), "f")
    return project(rows, found), named.select("f", "term", "row")


def encoded(weights: DataFrame, basis: DataFrame) -> DataFrame:
    """(qid, vector) of unit length for the weighted terms (qid, term, w) of questions, on a stored basis."""
    if basis.where("term is not null").isEmpty():
        rows = weights.withColumn("f", slot(max(basis.count(), 1))).withColumn("w", sign() * F.col("w")).join(basis.select("f", "row"), "f")
    else:
        rows = weights.join(basis.select("term", "row"), "term")
    sums = rows.select("qid", "w", F.posexplode("row").alias("i", "x")).groupBy("qid", "i").agg(F.sum(F.col("w") * F.col("x")).alias("x"))
    whole = sums.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("v"))
    return whole.select("qid", T.unit(F.transform("v", lambda e: e["x"])).alias("vector"))
