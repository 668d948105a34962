"""SimHash near-duplicates at a similarity: the general form of operator 7, as the pipeline uses it.

A text is the set of the hashes of its five-word shingles; equal sets form a class at once, told by
a 64-bit hash and, where that is one for different sets, by a second one. A class has the SimHash
fingerprint of its set. Two bits of 64 say little about a similarity of 0.8,
where some ten bits differ, and no choice of agreeing bits finds such pairs without comparing
most. So shards are named by bands of min-wise hashes, ROWS to a band: two classes of similarity
SIMILARITY share none of the BANDS bands once in 2e7. A shard holds a BK-tree of fingerprints, as
operator 7 has it; what it finds within RADIUS bits (a pair at 0.8 lies beyond once in 1e7) is linked
if the whole sets are at least SIMILARITY alike, checked exactly. At such a radius a tree prunes
little, since random fingerprints lie 32 bits apart; the shards' size bounds its searches.

Bands are taken in ROUNDS; between them the components are contracted, and a band whose classes
are in one component already is not read again. A band with more than HOT classes, or very long
ones, is dealt into blocks, each compared for itself. Classes of bands that this and all others
leave in several components meet once more, by ``prefixes``: shingles whose holders are all in one
component cannot link two, so they come first in an order of all shingles, and the others follow
from rare to frequent; two sets at SIMILARITY share one of the first shingles of both, at places
that bound how many they can share at all. Texts that have a template in common but are not alike
share none there. A first step compares each class with one of the largest component at a shingle;
only components that are then still apart meet class by class.

Edge cases: null and empty texts are one class, linked to no other; a text with fewer words than
a shingle is one shingle; rows without an id are kept; an empty table gives no row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clauseforge.llm.common import bounded_batches, cut
from clauseforge.llm.simhash import SEED, BKTree, components, keyed, majority, one_each

SHINGLE = 5
#: Links join sets that share at least so much of their union, as a fraction.
SIMILARITY = (4, 5)
BANDS = 32
ROWS = 4
#: Bands of each round.
ROUNDS = (2, 6, 24)
RADIUS = 30
HOT = 256
BLOCK = 128
#: Shingles of one block, about at most: very long texts make more blocks.
BLOCK_SHINGLES = 4 << 20
_DRAWN = np.random.default_rng(SEED).integers(0, 1 << 63, (3, BANDS * ROWS), np.uint64)
FACTORS, SHIFTS, MIXERS = _DRAWN[0] * np.uint64(2) + np.uint64(1), _DRAWN[1], _DRAWN[2] * np.uint64(2) + np.uint64(1)


def shingles(text: str | None) -> np.ndarray:
    """Sorted hashes of the different shingles."""
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    size = min(SHINGLE, len(words))
    digest = xxhash.xxh64_digest
    return np.unique(np.frombuffer(b"".join([digest(b" ".join(s), SEED) for s in zip(*(words[i:] for i in range(size)))]), np.uint64))


def bands(s: np.ndarray) -> np.ndarray:
    """One key for each band of a set, none for the empty one."""
    if not len(s):
        return np.zeros(0, np.int64)
    least = np.full(BANDS * ROWS, (1 << 64) - 1, np.uint64)
    for a in range(0, len(s), 1 << 12):
        np.minimum(least, ((s[a : a + (1 << 12), None] + SHIFTS) * FACTORS).min(axis=0), out=least)
    mixed = (least ^ (least >> np.uint64(29))) * MIXERS
    return (mixed ^ (mixed >> np.uint64(32))).reshape(BANDS, ROWS).sum(axis=1, dtype=np.uint64).view(np.int64)


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    over, under = SIMILARITY
    if min(len(a), len(b)) * under < max(len(a), len(b)) * over:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both * under >= (len(a) + len(b) - both) * over


def _classes(batches):
    import xxhash

    for batch in batches:
        sets = [shingles(t) for t in batch.column(2).to_pylist()]
        cls = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], np.uint64).view(np.int64)
        check = np.array([xxhash.xxh3_64_intdigest(s.tobytes(), SEED) for s in sets], np.uint64).view(np.int64)
        prints = np.array([majority(s.astype(">u8").view(np.uint8).reshape(-1, 8)) for s in sets], np.uint64).view(np.int64)
        keys = [bands(s) for s in sets]
        ends = np.cumsum([0, *map(len, keys)], dtype=np.int32)
        listed = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *keys])))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cls), pa.array(check), pa.array(prints), pa.array([len(s) for s in sets], pa.int64()), listed], names=["id", "key", "cls", "check", "fp", "size", "bands"])


def told_apart(members: DataFrame) -> DataFrame:
    """``members``, different sets of one hash ``cls`` named anew by their second one: of 5e10 sets some 70."""
    twins = members.groupBy("cls").agg(F.min("check").alias("low"), F.max("check").alias("high")).where("low < high")
    twins = cut(twins.select("cls", F.lit(True).alias("twin")))
    if twins.isEmpty():
        return members
    named = members.join(twins, "cls", "left").withColumn("cls", F.when(F.col("twin"), F.xxhash64("cls", "check")).otherwise(F.col("cls")))
    return cut(named.select(members.columns))


def _sets(batches):
    for batch in batches:
        sets = [shingles(t).tobytes() for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["cls", "s"])


def unit_links(held: list[tuple[int, int, int, bytes]]) -> list[tuple[int, int]]:
    """Links that join components among the (cls, root, fp, set) of one shard."""
    name = {root: k for k, root in enumerate({root for _, root, *_ in held})}
    if len(name) < 2:
        return []
    over, under = SIMILARITY
    cls = [x for x, *_ in held]
    sets = [np.frombuffer(s, np.uint64) for *_, s in held]
    root = np.array([name[r] for _, r, *_ in held])
    prints = np.array([fp for _, _, fp, _ in held], np.int64).view(np.uint64).tolist()
    size = [len(s) for s in sets]
    tree, of = BKTree(prints[0]), {prints[0]: [0]}
    out = []
    for x in range(1, len(held)):
        near = [y for fp in tree.within(prints[x], RADIUS) for y in of[fp]]
        for y in sorted(near):
            if root[x] != root[y] and min(size[x], size[y]) * under >= max(size[x], size[y]) * over and alike(sets[x], sets[y]):
                root[root == root[y]] = root[x]
                out.append((cls[x], cls[y]))
        tree.insert(prints[x])
        of.setdefault(prints[x], []).append(x)
    return out


def _pairs(out: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in zip(*out)], names=["a", "b"])


def _unit_links(batches):
    unit, held = None, []
    for batch in batches:
        for *at, cls, root, fp, s in zip(*(c.to_pylist() for c in batch.columns)):
            if at != unit:
                if out := unit_links(held):
                    yield _pairs(out)
                unit, held = at, []
            held.append((cls, root, fp, s))
    if out := unit_links(held):
        yield _pairs(out)


def compared(units: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) within the units (band, block) of rows (cls, root, fp)."""
    rows = units.join(sets, "cls").select("band", "block", "cls", "root", "fp", "s")
    dealt = rows.repartition("band", "block").sortWithinPartitions("band", "block", "root", "cls")
    return cut(dealt.mapInArrow(_unit_links, "a long, b long").distinct(), spent=True)


def rooted(rows: DataFrame, found: DataFrame) -> DataFrame:
    """``rows`` with the components that the links ``found`` make as ``root``."""
    root = components(found).select(F.col("v").alias("cls"), "root")
    return rows.join(root, "cls", "left").withColumn("root", F.coalesce("root", "cls"))


def open_bands(classes: DataFrame, found: DataFrame | None, first: int, n: int) -> DataFrame:
    """(band, cls, root, fp, size, n, total) of those of ``n`` bands whose classes are in several components as yet."""
    rows = classes.select("cls", "fp", "size", F.explode(F.slice("bands", first + 1, n)).alias("band"))
    rows = rows.withColumn("root", F.col("cls")) if found is None else rooted(rows, found)
    wide = rows.groupBy("band").agg(F.count("*").alias("n"), F.min("root").alias("low"), F.max("root").alias("high"), F.sum("size").alias("total")).where("low < high")
    return rows.join(wide.select("band", "n", "total"), "band")


def _tokens(batches):
    for batch in batches:
        sets = [np.frombuffer(s, np.uint64) for s in batch.column(3).to_pylist()]
        at = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        for a in range(0, len(at), 1 << 18):
            some = pa.array(at[a : a + (1 << 18)])
            token = np.concatenate(sets)[a : a + (1 << 18)].view(np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(some) for k in range(3)), pa.array(token)], names=["cls", "root", "size", "token"])


def prefixes(classes: DataFrame, sets: DataFrame) -> DataFrame:
    """Of the classes (cls, root, size) the first shingles that another component has too, in the order of all shingles.

    Rows (token, cls, root, size, reach, short): a class of another component that is alike shares one of the
    rows' tokens, is of at most ``reach`` shingles, and the smaller of the two has its row marked ``short``.
    """
    over, under = map(F.lit, SIMILARITY)
    held = classes.join(sets, "cls").select("cls", "root", "size", "s").mapInArrow(_tokens, "cls long, root long, size long, token long")
    met = held.groupBy("token").agg(F.count("*").alias("n"), F.min("root").alias("low"), F.max("root").alias("high")).where("low < high")
    mine = held.join(met.select("token", "n"), "token").groupBy("cls", "root", "size").agg(F.sort_array(F.collect_list(F.struct("n", "token"))).alias("open"))
    alone = F.col("size") - F.size("open")
    # The overlap of sets a and b of that similarity is over * (a + b) / (over + under) at least, and over * b / under.
    most = F.col("size") - F.ceil(F.col("size") * over / under) + 1 - alone
    rows = mine.where(most > 0).select("cls", "root", "size", alone.alias("alone"), F.posexplode(F.slice("open", 1, most.cast("int"))).alias("k", "x"))
    place = F.col("alone") + F.col("k")
    reach = F.floor((F.col("size") * under - place * (over + under)) / over)
    short = place <= F.col("size") - F.ceil(F.col("size") * over * 2 / (over + under))
    return rows.select(F.col("x.token").alias("token"), "cls", "root", "size", reach.alias("reach"), short.alias("short"))


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) of classes whose sets are alike."""

    def run(batches):
        for batch in batches:
            rows = zip(*(c.to_pylist() for c in batch.columns))
            if out := [(a, b) for a, b, x, y in rows if alike(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64))]:
                yield _pairs(out)

    of = lambda end: sets.select(F.col("cls").alias(end), F.col("s").alias(f"s_{end}"))
    rows = pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "s_a", "s_b")
    return cut(rows.mapInArrow(run, "a long, b long"), spent=True)


def prefix_links(classes: DataFrame, sets: DataFrame, found: DataFrame) -> DataFrame:
    """Links that join the components of the classes (cls, root, size), all pairs considered."""
    rows = cut(prefixes(classes, sets), spent=True)
    parts = rows.groupBy("token", "root").agg(F.count("*").alias("n"), F.min(F.struct(F.xxhash64("cls").alias("h"), "cls", "size", "reach")).alias("one"))
    star = parts.groupBy("token").agg(F.max(F.struct("n", "root", "one")).alias("top"))
    apart = (F.col("root") != F.col("top.root")) & (F.col("size") <= F.col("top.one.reach")) & (F.col("top.one.size") <= F.col("reach"))
    near = verified(rows.join(star, "token").where(apart).select(F.col("cls").alias("a"), F.col("top.one.cls").alias("b")).distinct(), sets)
    rows = cut(rooted(rows.drop("root"), found.unionByName(near)))
    met = rows.groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high")
    rows = rows.join(met.select("token"), "token", "left_semi")
    x, y = rows.where("short").alias("x"), rows.alias("y")
    ordered = F.struct(F.col("x.size"), F.col("x.cls")) < F.struct(F.col("y.size"), F.col("y.cls"))
    may = (F.col("x.token") == F.col("y.token")) & (F.col("x.root") != F.col("y.root")) & (F.col("y.size") <= F.col("x.reach")) & (F.col("x.size") <= F.col("y.reach"))
    pairs = x.join(y, may & ordered).select(F.col("x.cls").alias("a"), F.col("y.cls").alias("b")).distinct()
    return near.unionByName(verified(pairs, sets))


def links(docs: DataFrame, members: DataFrame, id_col: str, text_col: str, hot: int = HOT, block: int = BLOCK) -> DataFrame:
    """Links (a, b) between different classes of ``members`` that span all components."""
    row = F.struct(F.col("id").isNull().alias("none"), "id", "key")
    classes = members.groupBy("cls").agg(F.first("fp").alias("fp"), F.first("size").alias("size"), F.first("bands").alias("bands"), F.min(row).alias("row"))
    met = open_bands(classes, None, 0, BANDS).select("cls").distinct()
    classes = cut(classes.join(met, "cls", "left_semi"), spent=True)
    held = classes.select("cls", F.col("row.id").alias("id"), F.col("row.key").alias("key"))
    texts = keyed(docs, id_col, text_col).alias("t").join(held.alias("h"), F.col("t.id").eqNullSafe(F.col("h.id")) & (F.col("t.key") == F.col("h.key")))
    sets = cut(texts.select("cls", "text").mapInArrow(_sets, "cls long, s binary").dropDuplicates(["cls"]), spent=True)
    wide = (F.col("n") > hot) | (F.col("total") > BLOCK_SHINGLES)
    n_blocks = F.greatest(F.ceil(F.col("n") / block), F.ceil(F.col("total") / BLOCK_SHINGLES)).cast("long")
    own = F.when(wide, F.pmod(F.xxhash64("cls", "band"), n_blocks)).otherwise(0).cast("long")
    found, first = None, 0
    for n in ROUNDS:
        units = open_bands(classes, found, first, n).withColumn("block", own)
        new = compared(units, sets)
        found, first = new if found is None else cut(found.unionByName(new)), first + n
    if classes.isEmpty():
        return found
    left = cut(open_bands(classes, found, 0, BANDS).where(wide).select("cls", "root", "size").distinct())
    if left.isEmpty():
        return found
    return found.unionByName(prefix_links(left, sets, found))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Of the rows of each component of near copies the one with the least id, and all rows without an id."""
    bounded_batches(docs.sparkSession)
    members = cut(keyed(docs, id_col, text_col).mapInArrow(_classes, "id long, key long, cls long, check long, fp long, size long, bands array<long>"))
    members = told_apart(members)
    root = components(links(docs, members, id_col, text_col, **options))
    return one_each(docs, members.select("id", "key", "cls"), root.select(F.col("v").alias("cls"), "root"), id_col, text_col)
