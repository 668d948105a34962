"""SimHash near-duplicates by BK-trees over shards of fingerprints.

Fingerprints are made in one pass. Equal ones form a class at once, by an aggregation. Classes
whose fingerprints differ in at most ``radius`` bits agree wholly on all but ``radius`` of BLOCKS
bit blocks, so each class goes to the shards named by every choice of agreeing blocks; a shard
holds a BK-tree, whose searches follow only edges within the radius. Shards that hold more than
SHARD_ROWS classes are split the same way over the bits that are not fixed yet, down to all but
``radius`` of them, where a shard has a few rows at most: no shard grows with the data. A tree
reports each class's link to the first linked class before it and what joins their components,
so links stay as few as classes; components then come from alternating star contractions, each
round written to the shared checkpoint folder.

The trees are dealt out by shard key rather than broadcast: fingerprints of all documents have
no size bound.

Edge cases: null and empty texts have fingerprint zero, linked like any other; a text with fewer
words than a shingle is one shingle; copies and repeated ids are members of one class; an empty
table gives no row; rows without an id are kept; an id with several texts is decided text by
text; other columns of the input are not looked at.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clauseforge.llm.common import bounded_batches, cut, fresh, quoted

SHINGLE = 3
SEED = 42
RADIUS = 2
BLOCKS = 6
SHARD_ROWS = 512


def fingerprint(text: str | None) -> int:
    """Bit majority over the hashes of all shingles, as an unsigned 64-bit number."""
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    n = max(len(words) - SHINGLE + 1, 1)
    digest = xxhash.xxh64_digest
    shingles = map(b" ".join, zip(*(words[i:] for i in range(SHINGLE)))) if len(words) >= SHINGLE else [b" ".join(words)]
    return majority(np.frombuffer(b"".join([digest(s, SEED) for s in shingles]), np.uint8).reshape(n, 8))


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes, given as rows of eight bytes; 0 for none."""
    n, total = len(hashes), np.zeros(64, np.int64)
    for a in range(0, n, 1 << 14):
        total += np.unpackbits(hashes[a : a + (1 << 14)], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(total * 2 > n).tobytes(), "big")


def _fingerprints(batches):
    for batch in batches:
        prints = [fingerprint(t) for t in batch.column(batch.num_columns - 1).to_pylist()]
        signed = np.array(prints, np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(signed)], names=[*batch.schema.names[:-1], "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp) per row of ``docs``; fp is the fingerprint as a signed long."""
    bounded_batches(docs.sparkSession)
    kept = docs.select(quoted(id_col).cast("long").alias("id"), quoted(text_col).alias("text"))
    return kept.mapInArrow(_fingerprints, "id long, fp long")


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, key, text) per row of ``docs``; an id and the key of a text tell rows apart."""
    return docs.select(quoted(id_col).cast("long").alias("id"), F.xxhash64(quoted(text_col)).alias("key"), quoted(text_col).alias("text"))


def masks(free: int, blocks: int, radius: int) -> list[int]:
    """Masks of the bits that agree, one for each choice of ``radius`` blocks of ``free`` that may differ."""
    bits = [b for b in range(64) if free >> b & 1]
    blocks = min(blocks, len(bits))
    part = [sum(1 << b for b in bits[i * len(bits) // blocks : (i + 1) * len(bits) // blocks]) for i in range(blocks)]
    return [free & ~sum(p) for p in combinations(part, min(radius, blocks))]


class BKTree:
    """Children are keyed by their distance to the parent; equal keys are not inserted twice."""

    def __init__(self, root: int):
        self.root = root
        self.children: dict[int, dict[int, int]] = {root: {}}

    def insert(self, x: int) -> None:
        at = self.root
        while True:
            d = (at ^ x).bit_count()
            if not d:
                return
            nxt = self.children[at].get(d)
            if nxt is None:
                self.children[at][d] = x
                self.children[x] = {}
                return
            at = nxt

    def within(self, x: int, radius: int) -> list[int]:
        found, stack = [], [self.root]
        while stack:
            at = stack.pop()
            d = (at ^ x).bit_count()
            if d <= radius:
                found.append(at)
            kids = self.children[at]
            if len(kids) <= 2 * radius + 1:
                stack += [k for e, k in kids.items() if -radius <= e - d <= radius]
            else:
                stack += [kids[e] for e in range(d - radius, d + radius + 1) if e in kids]
        return found


def shard_links(prints: list[int], radius: int = RADIUS) -> list[tuple[int, int]]:
    """Links that span the components of one shard: at most one for each fingerprint."""
    if len(prints) < 2:
        return []
    tree, parent, out = BKTree(prints[0]), {prints[0]: prints[0]}, []

    def top(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for x in prints[1:]:
        if x in parent:
            continue
        parent[x] = x
        for y in tree.within(x, radius):
            if top(x) != top(y):
                parent[top(y)] = top(x)
                out.append((x, y))
        tree.insert(x)
    return out


def _links(radius: int):
    def run(batches):
        key, held = None, []
        out: list[tuple[int, int]] = []
        for batch in batches:
            rows = zip(*(c.to_pylist() for c in batch.columns))
            for free, shard, fp in rows:
                if (free, shard) != key:
                    if len(held) > 1:
                        out += shard_links(held, radius)
                    key, held = (free, shard), []
                held.append(fp & 0xFFFFFFFFFFFFFFFF)
            if out:
                yield _pairs(out)
                out = []
        if len(held) > 1:
            out += shard_links(held, radius)
        if out:
            yield _pairs(out)

    return run


def _pairs(links: list[tuple[int, int]]) -> pa.RecordBatch:
    ends = [pa.array(np.array(c, np.uint64).view(np.int64)) for c in zip(*links)]
    return pa.RecordBatch.from_arrays(ends, names=["a", "b"])


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


ROW = "free long, shard long, fp long"


def _deal(blocks: int, radius: int):
    """Rows (free, shard, fp) -> one row for each choice of blocks of the free bits that may differ."""

    def run(batches):
        known: dict[int, list[int]] = {}
        for batch in batches:
            frees = batch.column(0).to_numpy()
            prints = batch.column(2).to_numpy()
            out: list[list[np.ndarray]] = [[], [], []]
            for free in np.unique(frees).tolist():
                mine = prints[frees == free]
                bits = free & 0xFFFFFFFFFFFFFFFF
                if free not in known:
                    known[free] = [bits & ~m for m in masks(bits, blocks, radius)]
                for rest in known[free]:
                    out[0].append(np.full(len(mine), _signed(rest), np.int64))
                    out[1].append(mine & np.int64(_signed(~rest & 0xFFFFFFFFFFFFFFFF)))
                    out[2].append(mine)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], names=["free", "shard", "fp"])

    return run


def links(prints: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Links (a, b) between different fingerprints of column fp (distinct) that span all components."""
    rows = prints.select(F.lit(-1).cast("long").alias("free"), F.lit(0).cast("long").alias("shard"), "fp").mapInArrow(_deal(blocks, radius), ROW)
    out = None
    while True:
        key = ["free", "shard"]
        wide = F.bit_count("free") > radius  # narrower shards have a few rows at most
        hot = rows.where(wide).groupBy(*key).count().where(F.col("count") > shard_rows).select(*key)
        more = not hot.isEmpty()
        kept = rows.join(hot, key, "left_anti") if more else rows
        met = kept.withColumn("n", F.count("*").over(Window.partitionBy(*key))).where("n > 1").select("free", "shard", "fp")
        found = met.mapInArrow(_links(radius), "a long, b long")
        out = found if out is None else out.unionByName(found)
        if not more:
            return out.distinct()
        rows = cut(rows.join(hot, key, "left_semi").mapInArrow(_deal(blocks, radius), ROW).distinct())


def components(edges: DataFrame) -> DataFrame:
    """(v, root) for every vertex of ``edges`` (a, b) but the roots; root is the least vertex reachable."""
    ends = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct()
    ends, before = cut(ends), None
    while True:
        both = ends.unionByName(ends.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x"))
        ends = cut(small.select("x.u", "x.v").where("u > v").distinct())
        now = ends.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return ends.select(F.col("u").alias("v"), F.col("v").alias("root"))
        before = now


def grouped(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """(id, fp, component) per row of ``docs``; component is the least id that links lead to."""
    prints = cut(fingerprints(docs, id_col, text_col))
    classes = prints.groupBy("fp").agg(F.min("id").alias("first"))
    root = components(links(classes.select("fp"), radius))
    rooted = classes.join(root.select(F.col("v").alias("fp"), "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component"))
    return prints.join(rooted.join(least, "root").select("fp", "component"), "fp")


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint as 16 hex digits, component_id)."""
    rows = grouped(docs, id_col, text_col)
    return rows.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def one_each(docs: DataFrame, members: DataFrame, root: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without an id, and of the others one for each component: that of the least id.

    ``members`` has (id, key, cls) per row of ``docs``, ``root`` has (cls, root) for classes that are not their own root.
    """
    row = F.struct("id", "key")
    classes = members.groupBy("cls").agg(F.min(F.when(F.col("id").isNotNull(), row)).alias("first"))
    rooted = classes.join(root, "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    least = rooted.groupBy("root").agg(F.min("first").alias("first"))
    rows = cut(members.where("id IS NOT NULL").join(rooted.select("cls", "root").join(least, "root"), "cls").select("id", "key", (row == F.col("first")).alias("stays")))
    name, key, lone = fresh(docs, "_gone", "_key", "_lone")
    gone = rows.where("NOT stays").select(F.col("id").alias(name), F.col("key").alias(key)).distinct()
    out = docs.join(gone, (quoted(id_col) == F.col(name)) & (F.xxhash64(quoted(text_col)) == F.col(key)), "left_anti")
    if rows.where("stays").groupBy("id", "key").count().where("count > 1").isEmpty():
        return out
    out = out.withColumn(key, F.xxhash64(quoted(text_col))).withColumn(lone, F.when(quoted(id_col).isNull(), F.monotonically_increasing_id()))
    return out.dropDuplicates([id_col, key, lone]).select(*map(quoted, docs.columns))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of the rows of each component the one with the least id, and all rows without an id."""
    bounded_batches(docs.sparkSession)
    members = cut(keyed(docs, id_col, text_col).mapInArrow(_fingerprints, "id long, key long, fp long").withColumnRenamed("fp", "cls"))
    root = components(links(members.select(F.col("cls").alias("fp")).distinct()))
    return one_each(docs, members, root.select(F.col("v").alias("cls"), "root"), id_col, text_col)
