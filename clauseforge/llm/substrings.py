"""Exact removal of repeated 50-byte strings by suffix arrays over shards.

Documents are held in blobs of a few MB. Each 50-byte window is assigned the least hash among its
16-byte grams; windows in a row with the same gram form a context. Equal windows have the same
gram wherever they stand, so contexts are dealt to shards by gram: no match crosses shards.

0. Each blob sends the SHA-256 of its different texts with their least id. A text that a lesser id has
   goes whole, and is left out of all that follows: the lesser id's windows are the same.
1. Each blob sends its distinct grams; a gram met in two blobs is told to both.
2. Each blob sends the contexts whose gram is met elsewhere, in another blob or another document;
   equal contexts of one blob are sent once, with the least document id; what copies what is
   passed on to the last step.
3. A shard builds the suffix array of its contexts by induced sorting and the permuted common
   prefixes (``suffix``). Suffixes that share 50 bytes or more with their forerunner form groups;
   a window goes if its group's least document id is less than its own.
4. Each blob cuts the bytes under such windows out of its documents.

   A context that shares neither its gram with the HALF bytes before it nor that with the HALF bytes
   behind it with another one is left out of the array: a window has one of the two whole.

Grams of very many blobs (HOT_BLOBS) are dealt out by whole windows instead, so what a shard
gets for one string is at most a row a blob, however often documents repeat it. Shards work in
pieces of PIECE_BYTES. Blobs and decisions are told apart by the place in the input, so blobs are
first written to the shared checkpoint folder; a lost executor's work is done again from there.

Edge cases: null text is empty, has no bytes and no spans; texts under 50 bytes lose nothing; of
equal texts the least document id keeps its own; rows that repeat an id count as one document; a
null id counts as larger than all; an empty table gives no row; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clauseforge.llm.common import bounded_batches, cut, quoted
from clauseforge.llm.suffix import common_prefixes, suffix_array

LENGTH = 50
GRAM = 16
#: A window has so many bytes on one side of its gram at least.
HALF = (LENGTH - GRAM) // 2
BLOB_BYTES = 2 << 20
#: Bytes of text for which there is one shard of whole texts, of grams, or of contexts.
TEXT_SHARD_BYTES, GRAM_SHARD_BYTES, SUFFIX_SHARD_BYTES = 64 << 20, 16 << 20, 4 << 20
#: Blobs of one task; tasks that shards are dealt to, at most (a task takes its shards in turn).
TASK_BLOBS, MOST_TASKS = 2, 20_000
PIECE_BYTES = 8 << 20
#: Grams are hashed in parts that stay in a core's cache.
PART_BYTES = 128 << 10
#: A longer row of windows with one gram is cut, so that equal stretches meet as equal contexts.
LONGEST = 512
HOT_BLOBS = 20_000
NO_ID = (1 << 63) - 1
CODEC = "zstd"
U = np.uint64
#: Odd multipliers of the hashes.
M1, M2, M3, M4 = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
ROWS = "k long, kind int, blob long, data binary"


def squeezed(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + pa.Codec(CODEC).compress(data, asbytes=True)


def restored(data: bytes) -> bytes:
    return pa.Codec(CODEC).decompress(data[8:], int.from_bytes(data[:8], "little"), asbytes=True)


def joined(*arrays: np.ndarray) -> bytes:
    return b"".join([np.array([len(a) for a in arrays], "<u8").tobytes(), *(a.tobytes() for a in arrays)])


def parted(data: bytes, *kinds: str) -> list[np.ndarray]:
    sizes, at, out = np.frombuffer(data, "<u8", len(kinds)), 8 * len(kinds), []
    for n, kind in zip(sizes.tolist(), kinds):
        out.append(np.frombuffer(data, kind, n, at))
        at += n * np.dtype(kind).itemsize
    return out


class Blob:
    """Documents one after the other: ids, sizes and bytes."""

    def __init__(self, data: bytes):
        self.ids, self.sizes, self.bytes = parted(restored(data), "<i8", "<i8", "u1")
        self.ends = np.cumsum(self.sizes)

    @staticmethod
    def packed(ids: list[int], texts: list[bytes]) -> bytes:
        return squeezed(joined(np.array(ids, "<i8"), np.array([len(t) for t in texts], "<i8"), np.frombuffer(b"".join(texts), "u1")))

    def alike(self) -> tuple[np.ndarray, dict[bytes, int]]:
        """For each document the first equal one of the least id, itself if it has no window; and these by SHA-256."""
        of, known = np.arange(len(self.ids)), {}
        order = np.argsort(self.ids, kind="stable")
        order = order[self.sizes[order] >= LENGTH]
        data = memoryview(self.bytes)
        of[order] = [known.setdefault(hashlib.sha256(data[b - n : b]).digest(), k) for k, b, n in zip(order.tolist(), self.ends[order].tolist(), self.sizes[order].tolist())]
        return of, known

    def copies(self, told: list[bytes]) -> np.ndarray:
        """Which documents a lesser id has whole, here or, as ``told``, in another blob."""
        of, _ = self.alike()
        return (self.ids > self.ids[of]) | np.isin(of, np.frombuffer(b"".join(told), "<u4"))

    def only(self, stay: np.ndarray) -> Blob:
        """The blob of some documents alone."""
        out = Blob.__new__(Blob)
        out.ids, out.sizes, out.bytes = self.ids[stay], self.sizes[stay], self.bytes[np.repeat(stay, self.sizes)]
        out.ends = np.cumsum(out.sizes)
        return out

    def parts(self):
        """Runs of documents of about PART_BYTES: (first byte, last byte, first document, last document)."""
        a = 0
        while a < len(self.sizes):
            base = int(self.ends[a] - self.sizes[a])
            b = max(a + 1, int(np.searchsorted(self.ends, base + PART_BYTES, side="right")))
            yield base, int(self.ends[b - 1]), a, b
            a = b


def hashes(data: np.ndarray, length: int) -> np.ndarray:
    """A hash of the ``length`` bytes at each place."""
    step = lambda h, k, more: h[: len(more)] * U(pow(M1, k, 1 << 64)) + more
    one = (data.astype(U) + U(1)) * U(M2)
    h, n = one, 1
    for bit in bin(length)[3:]:
        h, n = step(h, n, h[n:]), 2 * n
        if bit == "1":
            h, n = step(h, 1, one[n:]), n + 1
    h ^= h >> U(29)
    h *= U(M3)
    h ^= h >> U(32)
    return h


def windows(data: np.ndarray) -> np.ndarray:
    """The least gram hash of each window of LENGTH bytes."""
    h = hashes(data, GRAM)
    span, n = LENGTH - GRAM + 1, 1
    while n * 2 <= span:
        h = np.minimum(h[:-n], h[n:])
        n *= 2
    return np.minimum(h[: -(span - n)], h[span - n :]) if span > n else h


def mixed(v: np.ndarray) -> np.ndarray:
    v = v * U(M4)
    v ^= v >> U(31)
    return v * U(M1)


def shard_of(v: np.ndarray, shards: int) -> np.ndarray:
    return ((v >> U(44)).astype(np.int64) * shards) >> 20


class Contexts:
    """Of one blob, by place: gram hash, first window, number of windows, and document."""

    def __init__(self, blob: Blob):
        v, start, doc = [np.zeros(0, U)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        n = [np.zeros(0, np.int64)]
        for a, b, first, last in blob.parts():
            if b - a < LENGTH:
                continue
            least = windows(blob.bytes[a:b])
            cuts = least[1:] != least[:-1]
            own = blob.ends[first:last] - a
            for edge in (own - LENGTH, own - 1):  # behind a document's last window, and at the next one's start
                edge = edge[(edge >= 0) & (edge < len(cuts))]
                cuts[edge] = True
            at = np.append(0, np.flatnonzero(cuts) + 1)
            size = np.diff(np.append(at, len(least)))
            owner = np.searchsorted(own, at, side="right")
            good = at + LENGTH <= own[np.minimum(owner, len(own) - 1)]
            at, size, owner = at[good], size[good], owner[good]
            if len(size) and size.max() > LONGEST:
                k = -(-size // LONGEST)
                piece = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
                at, size, owner = np.repeat(at, k) + piece * LONGEST, np.repeat(size, k) - piece * LONGEST, np.repeat(owner, k)
                size = np.minimum(size, LONGEST)
            v.append(mixed(least[at]))
            start.append(at + a)
            n.append(size)
            doc.append(owner + first)
        self.v, self.start, self.n, self.doc = (np.concatenate(x) for x in (v, start, n, doc))
        self.id = blob.ids[self.doc]

    def representatives(self, blob: Blob) -> tuple[np.ndarray, np.ndarray]:
        """For each context the first equal one of the least id; and which grams equal or other contexts share."""
        rep = np.arange(len(self.v))
        order = np.argsort(self.v)
        o = self.v[order]
        twin = np.zeros(len(o), bool)
        twin[1:] = o[1:] == o[:-1]
        twin[:-1] |= twin[1:]
        some = order[twin]
        some = some[np.lexsort((self.start[some], self.id[some]))]
        data, known = blob.bytes.tobytes(), {}
        a = self.start[some]
        rep[some] = [known.setdefault(data[x:y], k) for k, x, y in zip(some.tolist(), a.tolist(), (a + self.n[some] + LENGTH - 1).tolist())]
        several = np.zeros(len(o), bool)
        several[some] = True
        return rep, several


def content(data: bytes, start: np.ndarray) -> np.ndarray:
    """A hash of the window at each place."""
    return np.fromiter((int.from_bytes(hashlib.blake2b(data[a : a + LENGTH], digest_size=8).digest(), "little") for a in start.tolist()), U, len(start))


def stretches(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places of all stretches one after the other."""
    base = np.cumsum(size) - size
    return np.arange(size.sum()) - np.repeat(base, size) + np.repeat(start, size)


def table(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["k", "kind", "blob", "data"])


def by_key(batches):
    """Rows (kind, blob, data) of each key in turn; rows come sorted by key and kind."""
    flat = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
    for key, rows in groupby(flat, key=lambda r: r[0]):
        yield key, (r[1:] for r in rows)


def blobs_of(blob_bytes: int):
    def row(number: int, held: int, ids: list, texts: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([number]), pa.array([held]), pa.array([Blob.packed(ids, texts)], pa.binary())], names=["blob", "n_bytes", "data"])

    def run(batches):
        number, ids, texts, held = TaskContext.get().partitionId() << 32, [], [], 0
        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids.append(NO_ID if i is None else i)
                texts.append(t.encode() if t else b"")
                held += len(texts[-1])
                if held >= blob_bytes or len(ids) >= 1 << 16:
                    yield row(number, held, ids, texts)
                    number, ids, texts, held = number + 1, [], [], 0
        if ids:
            yield row(number, held, ids, texts)

    return run


def send_texts(shards: int):
    """Blob -> for each shard of whole texts the blob's different ones: least id, place, SHA-256."""

    def run(batches):
        for batch in batches:
            for blob, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held, dealt = Blob(data), {}
                for name, k in held.alike()[1].items():
                    dealt.setdefault(int.from_bytes(name[:4], "big") * shards >> 32, []).append((k, name))
                rows = []
                for shard, texts in dealt.items():
                    at = np.array([k for k, _ in texts], "<u4")
                    rows.append((shard, 0, blob, joined(held.ids[at].astype("<i8"), at, np.frombuffer(b"".join(name for _, name in texts), "u1"))))
                if rows:
                    yield table(rows)

    return run


def known_texts(batches):
    """Whole texts of a shard -> to each blob the places of those that a lesser id has in another one: kind -1."""
    for _, rows in by_key(batches):
        least, got = {}, []
        for _, blob, data in rows:
            ids, at, names = parted(data, "<i8", "<u4", "u1")
            names = names.tobytes()
            got.append((blob, ids.tolist(), at, [names[a : a + 32] for a in range(0, len(names), 32)]))
            for i, name in zip(got[-1][1], got[-1][3]):
                least[name] = min(i, least.get(name, NO_ID))
        out = []
        for blob, ids, at, names in got:
            later = at[[i > least[name] for i, name in zip(ids, names)]]
            if len(later):
                out.append((blob, -1, blob, later.tobytes()))
        for a in range(0, len(out), 1024):
            yield table(out[a : a + 1024])


def send_grams(shards: int):
    """A blob's copies, then the blob (kind 2) -> for each shard of grams the low 40 bits of the distinct grams of its other texts."""

    def run(batches):
        for blob, rows in by_key(batches):
            told = []
            for kind, _, data in rows:
                if kind < 0:
                    told.append(data)
                    continue
                held = Blob(data)
                v = np.unique(Contexts(held.only(~held.copies(told))).v)
                shard = shard_of(v, shards)
                at = np.flatnonzero(np.append(True, shard[1:] != shard[:-1])) if len(v) else np.zeros(0, np.int64)
                rows = [(int(shard[a]), 0, blob, narrow(v[a:b])) for a, b in zip(at.tolist(), [*at[1:].tolist(), len(v)])]
                if rows:
                    yield table(rows)

    return run


def wide(data: bytes) -> np.ndarray:
    """40-bit numbers as 64-bit ones."""
    out = np.zeros((len(data) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(data, np.uint8).reshape(-1, 5)
    return out.view("<u8").reshape(-1)


def narrow(v: np.ndarray) -> bytes:
    return v.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def shared_grams(hot_blobs: int):
    """All blobs' grams of a shard -> to each blob those that another one has: kind 0, and 1 for hot ones."""

    def run(batches):
        for _, rows in by_key(batches):
            blobs, grams = [], []
            for _, blob, data in rows:
                blobs.append(blob)
                grams.append(wide(data))
            distinct, times = np.unique(np.concatenate(grams), return_counts=True)
            some, hot = distinct[(times > 1) & (times <= hot_blobs)], distinct[times > hot_blobs]
            out = []
            for blob, g in zip(blobs, grams):
                for kind, known in ((0, some), (1, hot)):
                    if len(known):
                        mine = g[known[np.minimum(np.searchsorted(known, g), len(known) - 1)] == g]
                        if len(mine):
                            out.append((blob, kind, blob, narrow(mine)))
            if out:
                yield table(out)

    return run


def send_contexts(shards: int):
    """A blob's copies and shared grams, then the blob (kind 2) -> for each shard its contexts; kind 1: what copies what."""

    def run(batches):
        for blob, rows in by_key(batches):
            known: list[list[np.ndarray]] = [[], []]
            told = []
            for kind, _, data in rows:
                if kind < 0:
                    told.append(data)
                    continue
                if kind < 2:
                    known[kind].append(wide(data))
                    continue
                held = Blob(data)
                held = held.only(~held.copies(told))
                c = Contexts(held)
                of, several = c.representatives(held)
                own = of == np.arange(len(of))
                copies = np.flatnonzero(~own)
                out = []
                if len(copies):
                    later = c.id[copies] > c.id[of[copies]]
                    out.append((blob % shards, 1, blob, squeezed(joined(c.start[of[copies]].astype("<u4"), c.start[copies].astype("<u4"), c.n[copies].astype("<u2"), later.astype("u1")))))
                low = c.v & U((1 << 40) - 1)
                some, hot = (np.isin(low, np.concatenate(x)) if x else np.zeros(len(own), bool) for x in known)
                picked = np.flatnonzero(own & (some | several) & ~hot)
                start, n, doc, key = c.start[picked], c.n[picked], c.id[picked], c.v[picked]
                if hot.any():
                    hot = np.flatnonzero(own & hot)
                    each = stretches(c.start[hot], c.n[hot])
                    start, n = np.append(start, each), np.append(n, np.ones(len(each), np.int64))
                    doc = np.append(doc, np.repeat(c.id[hot], c.n[hot]))
                    key = np.append(key, content(held.bytes.tobytes(), each))
                shard = shard_of(key, shards)
                order = np.argsort(shard.astype(np.int32), kind="stable")
                shard, start, n, doc = (x[order] for x in (shard, start, n, doc))
                at = np.flatnonzero(np.append(True, shard[1:] != shard[:-1])) if len(shard) else shard
                for a, b in zip(at.tolist(), [*at[1:].tolist(), len(shard)]):
                    places = stretches(start[a:b], n[a:b] + LENGTH - 1)
                    out.append((int(shard[a]), 0, blob, squeezed(joined(doc[a:b].astype("<i8"), start[a:b].astype("<u4"), n[a:b].astype("<u2"), held.bytes[places]))))
                for a in range(0, len(out), 1024):
                    yield table(out[a : a + 1024])

    return run


def least_ids(contexts: list[bytes], ids: np.ndarray) -> np.ndarray:
    """For each place of the contexts, joined by one separator, the least id of its window's group."""
    sizes = np.fromiter(map(len, contexts), np.int64, len(contexts))
    text = np.frombuffer(b"\0".join(contexts) + b"\0\0", np.uint8).astype(np.uint16) + np.uint16(2)
    stops = np.cumsum(sizes + 1) - 1
    text[stops], text[-1] = 1, 0
    order = suffix_array(text, 258)
    prefix = common_prefixes(text, order)
    own = np.full(len(text), NO_ID, np.int64)
    first = stops - sizes
    own[stretches(first, sizes - LENGTH + 1)] = np.repeat(ids, sizes - LENGTH + 1)
    new = np.flatnonzero(prefix[order] < LENGTH)
    least = np.minimum.reduceat(own[order], new)
    out = np.empty(len(text), np.int64)
    out[order] = np.repeat(least, np.diff(np.append(new, len(text))))
    return out


def pieces(whole: np.ndarray, size: np.ndarray, stop: np.ndarray) -> list[np.ndarray]:
    """The contexts in parts of about PIECE_BYTES that have no gram in common."""
    if stop[-1] <= PIECE_BYTES:
        return [np.arange(len(size))]
    gram = windows(whole)[stop - size]
    order = np.argsort(gram, kind="stable")
    gram, reach = gram[order], np.cumsum(size[order])
    first = np.append(True, gram[1:] != gram[:-1])
    part = np.maximum.accumulate(np.where(first, (reach - size[order]) // PIECE_BYTES, 0))
    return np.split(order, np.flatnonzero(part[1:] != part[:-1]) + 1)


def meeting(data: np.ndarray, gram: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Which of the contexts in ``data`` share a gram with HALF bytes before or behind it with another one.

    The gram of a window may stand at several places of its context; each of them counts.
    """
    stop = np.cumsum(size)
    first = stop - size
    at = np.flatnonzero(hashes(data, GRAM) == np.repeat(gram, size)[: 1 - GRAM])
    owner = np.searchsorted(stop, at, side="right")
    long = hashes(data, GRAM + HALF)
    out = np.zeros(len(size), bool)
    for back in (HALF, 0):
        good = (at - back >= first[owner]) & (at - back + GRAM + HALF <= stop[owner])
        key, of = long[at[good] - back], owner[good]
        if not len(key):
            continue
        order = np.argsort(key)
        key, of = key[order], of[order]
        new = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        several = np.minimum.reduceat(of, new) < np.maximum.reduceat(of, new)
        out[of[np.repeat(several, np.diff(np.append(new, len(key))))]] = True
    return out


def least_by_window(contexts: list[bytes], ids: np.ndarray, n: np.ndarray) -> np.ndarray:
    """For each window of the distinct contexts the least id that has it.

    A context whose gram no other one has, or none with either half of a window beside it, holds
    windows of its own only; all others are compared by their suffix array.
    """
    size = n + LENGTH - 1
    gram = windows(np.frombuffer(b"".join(contexts), np.uint8))[np.cumsum(size) - size]
    _, of, times = np.unique(gram, return_inverse=True, return_counts=True)
    met = np.flatnonzero(times[of] > 1)
    out = np.repeat(ids, n)
    if len(met):
        met = met[meeting(np.frombuffer(b"".join([contexts[k] for k in met.tolist()]), np.uint8), gram[met], size[met])]
    if len(met):
        least = least_ids([contexts[k] for k in met.tolist()], ids[met])
        first = np.cumsum(size[met] + 1) - size[met] - 1
        base = np.cumsum(n) - n
        out[stretches(base[met], n[met])] = least[stretches(first, n[met])]
    return out


def decide(rows: list[tuple]) -> list[tuple]:
    """Contexts of one shard -> to each blob the rows of windows that go: the first, and how many."""
    got = [(blob, *parted(restored(data), "<i8", "<u4", "<u2", "u1")) for blob, data in rows]
    blob = np.concatenate([np.full(len(g[1]), g[0], np.int64) for g in got])
    doc, start, n = (np.concatenate([g[k] for g in got]).astype(np.int64) for k in (1, 2, 3))
    size = n + LENGTH - 1
    stop = np.cumsum(size)
    whole = np.concatenate([g[4] for g in got])
    data = whole.tobytes()
    out: list[tuple] = []
    for mine in pieces(whole, size, stop):
        number: dict[bytes, int] = {}
        of = np.fromiter((number.setdefault(data[e - s : e], len(number)) for s, e in zip(size[mine].tolist(), stop[mine].tolist())), np.int64, len(mine))
        contexts = list(number)
        ids = np.full(len(contexts), NO_ID, np.int64)
        np.minimum.at(ids, of, doc[mine])
        windows_of = np.fromiter(map(len, contexts), np.int64, len(contexts)) - (LENGTH - 1)
        least = least_by_window(contexts, ids, windows_of)
        base = np.cumsum(windows_of) - windows_of
        k = n[mine]
        gone = least[stretches(base[of], k)] < np.repeat(doc[mine], k)
        place = stretches(start[mine], k)
        edge = np.cumsum(k) - k
        before = np.append(False, gone[:-1])
        before[edge] = False
        after = np.append(gone[1:], False)
        after[edge[1:] - 1] = False
        opens, shuts = np.flatnonzero(gone & ~before), np.flatnonzero(gone & ~after)
        owner = np.repeat(blob[mine], k)[opens]
        by = np.argsort(owner, kind="stable")
        owner, lo, hi = owner[by], place[opens][by], place[shuts][by] + 1
        at = np.flatnonzero(np.append(True, owner[1:] != owner[:-1])) if len(owner) else owner
        for x, y in zip(at.tolist(), [*at[1:].tolist(), len(owner)]):
            out.append((int(owner[x]), 0, int(owner[x]), joined(lo[x:y].astype("<u4"), (hi - lo)[x:y].astype("<u2"))))
    return out


def decisions(batches):
    for _, rows in by_key(batches):
        mine = []
        for kind, blob, data in rows:
            if kind == 0:
                mine.append((blob, data))
            else:
                yield table([(blob, 1, blob, data)])
        out = decide(mine) if mine else []
        for a in range(0, len(out), 1024):
            yield table(out[a : a + 1024])


def removal(size: int, gone: list[tuple[np.ndarray, np.ndarray]], copies: list[list[np.ndarray]]) -> np.ndarray:
    """Which bytes of a blob go: rows of windows that the shards have sent, and the blob's own copies."""
    edge = np.zeros(size + 1, np.int32)
    for lo, n in gone:
        np.add.at(edge, lo, 1)
        np.add.at(edge, lo + n, -1)
    window = np.cumsum(edge[:-1]) > 0
    for rep, own, n, later in copies:
        same, later = later == 0, later == 1
        seen = window[stretches(rep[same], n[same])]
        window[stretches(own[same], n[same])] |= seen
        window[stretches(own[later], n[later])] = True
    flips = np.flatnonzero(np.diff(np.concatenate([[0], window.astype(np.int8), [0]])))
    edge[:] = 0
    np.add.at(edge, flips[::2], 1)
    np.add.at(edge, np.minimum(flips[1::2] + LENGTH - 1, size), -1)
    return np.cumsum(edge[:-1]) > 0


def kept_texts(batches):
    """A blob's copies and decisions, then the blob (kind 2) -> a row a document: sizes and the bytes that stay."""
    for _, rows in by_key(batches):
        told, gone, copies = [], [], []
        for kind, _, data in rows:
            if kind < 0:
                told.append(data)
                continue
            if kind == 0:
                gone.append(tuple(x.astype(np.int64) for x in parted(data, "<u4", "<u2")))
                continue
            if kind == 1:
                copies.append([x.astype(np.int64) for x in parted(restored(data), "<u4", "<u4", "<u2", "u1")])
                continue
            whole = Blob(data)
            copied = whole.copies(told)
            blob = whole.only(~copied)
            drop = removal(len(blob.bytes), gone, copies)
            first = blob.ends - blob.sizes
            opens = drop & ~np.append(False, drop[:-1])
            opens[first[blob.sizes > 0]] = drop[first[blob.sizes > 0]]
            total = lambda x: (s := np.append(0, np.cumsum(x)))[blob.ends] - s[first]
            removed, spans = whole.sizes.copy(), np.ones(len(whole.ids), np.int64)
            removed[~copied], spans[~copied] = total(drop), total(opens)
            stay = blob.bytes[~drop].tobytes()
            ends = np.cumsum(whole.sizes - removed).tolist()
            ids = pa.array([None if i == NO_ID else i for i in whole.ids.tolist()], pa.int64())
            texts = pa.array([stay[a:b] for a, b in zip([0, *ends], ends)], pa.binary())
            out = pa.RecordBatch.from_arrays([ids, pa.array(whole.sizes), pa.array(removed), pa.array(spans), texts], names=["id", "n_bytes", "n_removed", "n_spans", "kept"])
            yield from (out.slice(a, 2048) for a in range(0, len(ends), 2048))


def _dealt(rows: DataFrame, task, tasks: int) -> DataFrame:
    """Rows in tasks by number, not by hash, so that all tasks have as many shards or blobs."""
    n = max(1, min(tasks, MOST_TASKS))
    return rows.repartitionById(n, F.pmod(task, F.lit(n)).cast("int")).sortWithinPartitions("k", "kind")


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", blob_bytes: int = BLOB_BYTES, hot_blobs: int = HOT_BLOBS, shards: int | None = None) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept) per row of ``docs``; kept holds the bytes that stay."""
    bounded_batches(docs.sparkSession)
    pairs = docs.select(quoted(id_col).cast("long").alias("id"), quoted(text_col).alias("text"))
    blobs = cut(pairs.mapInArrow(blobs_of(blob_bytes), "blob long, n_bytes long, data binary"))
    partition, number = F.shiftright("k", 32), F.col("k").bitwiseAND(F.lit((1 << 32) - 1))
    size, n_blobs, last = blobs.agg(F.sum("n_bytes"), F.count("*"), F.max(F.shiftright("blob", 32))).first()
    n_grams = shards or min((size or 0) // GRAM_SHARD_BYTES + 1, 1 << 20)
    n_suffixes = shards or min((size or 0) // SUFFIX_SHARD_BYTES + 1, 1 << 20)
    by_blob = number * ((last or 0) + 1) + partition, n_blobs // TASK_BLOBS
    n_texts = shards or min((size or 0) // TEXT_SHARD_BYTES + 1, 1 << 20)
    texts = blobs.select("blob", "data").mapInArrow(send_texts(n_texts), ROWS)
    copies = cut(_dealt(texts, F.col("k"), n_texts).mapInArrow(known_texts, ROWS), spent=True)
    held = blobs.select(F.col("blob").alias("k"), F.lit(2).alias("kind"), "blob", "data").unionByName(copies)
    grams = _dealt(held, *by_blob).mapInArrow(send_grams(n_grams), ROWS)
    shared = cut(_dealt(grams, F.col("k"), n_grams).mapInArrow(shared_grams(hot_blobs), ROWS), spent=True)
    contexts = _dealt(shared.unionByName(held), *by_blob).mapInArrow(send_contexts(n_suffixes), ROWS)
    gone = cut(_dealt(contexts, F.col("k"), n_suffixes).mapInArrow(decisions, ROWS), spent=True)
    out = _dealt(gone.unionByName(held), *by_blob).mapInArrow(kept_texts, "id long, n_bytes long, n_removed long, n_spans long, kept binary")
    return out.withColumnRenamed("id", id_col)


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256)."""
    rows = without_repeats(docs, id_col, text_col, **options)
    return rows.select(id_col, "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
