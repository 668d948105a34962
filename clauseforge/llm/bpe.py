"""Token counts by rank-synchronous merging of ragged symbol arrays.

The vocabulary file is a word-end byte-pair vocabulary: NFC, lower case, white space dropped.
All pre-tokens that a batch has not met before lie in one flat array of symbols with segment
ids. Each round finds every segment's pair of lowest rank, merges all its occurrences at
once (left to right where they overlap), and retires the segments that have no pair left.

Edge cases: null text counts as empty (0 bytes, 0 tokens); strings of special tokens inside a
text count as one token each, which is the library's default; texts of any length are read
whole; columns other than the id and the text are not touched, so clashing names do no harm.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clauseforge.llm.common import bounded_batches, quoted

#: Words of a worker's memo; a full memo becomes the older one, from which words in use come back.
MEMO_WORDS = 300_000
#: A text is split on the fast path only if it holds nothing but these characters.
UNUSUAL = re.compile("[^\t-\r -~À-ɏ]")
PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\w\s]|_)+")
#: Texts whose unknown words are merged together.
STEP = 512
#: Slots of a hash table over the merges, as a power of two.
HASH_BITS = 20
NO_RANK = np.int64(1) << 60


def byte_letters() -> dict[int, str]:
    """The printable letter that byte-level vocabularies write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class RankMerger:
    """The merges of one vocabulary as sorted arrays."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        self.end = spec["model"].get("end_of_word_suffix") or ""
        self.size = max(vocab.values()) + 1
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], dtype=np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int32)
        order = np.argsort(keys, kind="stable")
        self.keys, self.made, self.rank = keys[order], made[order], order.astype(np.int64)
        self.tables = []
        left = np.arange(len(self.keys), dtype=np.int32)
        while len(left):  # each table holds one key a slot; keys that lose a slot go to the next
            table = np.full(1 << HASH_BITS, -1, np.int32)
            table[self.slot(self.keys[left], len(self.tables))] = left
            self.tables.append(table)
            left = left[table[self.slot(self.keys[left], len(self.tables) - 1)] != left]
        letters = byte_letters()
        self.inner = np.array([vocab[letters[b]] for b in range(256)], dtype=np.int32)
        self.last = np.array([vocab[letters[b] + self.end] for b in range(256)], dtype=np.int32)
        self.bytes_of = {c: b for b, c in letters.items()}
        whole = Tokenizer.from_file(path)
        self.normalizer, self.pre = whole.normalizer, whole.pre_tokenizer
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        names = sorted(map(re.escape, self.special), key=len, reverse=True)
        self.marks = re.compile("(" + "|".join(names) + ")") if names else None

    @staticmethod
    def slot(key: np.ndarray, table: int) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15 + 2 * table)) >> np.uint64(64 - HASH_BITS)).astype(np.int64)

    def find(self, key: np.ndarray) -> np.ndarray:
        """Index of each key among the merges, -1 if there is no such pair."""
        found = np.full(len(key), -1, np.int32)
        open_ = np.arange(len(key))
        for n, table in enumerate(self.tables):
            at = table[self.slot(key[open_], n)]
            right = (at >= 0) & (self.keys[at] == key[open_])
            found[open_[right]] = at[right]
            open_ = open_[(at >= 0) & ~right]
        return found

    def merge(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all non-empty pieces one after the other, and each piece's number of ids."""
        if not pieces:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        raw = np.frombuffer(b"".join(pieces), np.uint8)
        flat = self.inner[raw]
        ends = np.cumsum(sizes) - 1
        flat[ends] = self.last[raw[ends]]
        seg = np.repeat(np.arange(len(pieces)), sizes)
        done_ids, done_seg = [], []
        while len(flat):
            same = seg[1:] == seg[:-1]
            key = flat[:-1].astype(np.int64) * self.size + flat[1:]
            at = self.find(key)
            rank = np.where(same & (at >= 0), self.rank[at], NO_RANK)
            rank = np.append(rank, NO_RANK)
            starts = np.flatnonzero(np.append(True, ~same))
            least = np.minimum.reduceat(rank, starts)
            lengths = np.diff(np.append(starts, len(flat)))
            least = np.repeat(least, lengths)
            live = least < NO_RANK
            if not live.all():
                done_ids.append(flat[~live])
                done_seg.append(seg[~live])
            hit = (rank == least) & live
            i = np.flatnonzero(hit)
            if not len(i):
                break
            # Overlapping occurrences of one pair: every second of a run merges, from its left end.
            run_start = np.append(True, np.diff(i) != 1)
            first = i[run_start][np.cumsum(run_start) - 1]
            i = i[(i - first) % 2 == 0]
            flat[i] = self.made[at[i]]
            live[i + 1] = False
            flat, seg = flat[live], seg[live]
        ids, owner = np.concatenate(done_ids), np.concatenate(done_seg)
        order = np.argsort(owner, kind="stable")
        return ids[order], np.bincount(owner, minlength=len(pieces))


@lru_cache(maxsize=2)
def merger(path: str) -> RankMerger:
    return RankMerger(path)


class Encoder:
    """Ids of whole texts; remembers the ids of the words met before, up to a bound."""

    def __init__(self, path: str):
        self.model = merger(path)
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def learn(self, words: set[str]) -> None:
        new = words - self.memo.keys()
        if known := new & self.older.keys():
            self.memo.update({w: self.older[w] for w in known})
            new -= known
        new = list(new)
        found = [(w,) if w.isalpha() else PIECE.findall(w) for w in new]
        distinct = list(dict.fromkeys(x for f in found for x in f))
        ids, lengths = self.model.merge([x.encode() for x in distinct])
        packed, stops = ids.astype("<u4").tobytes(), (4 * np.cumsum(lengths)).tolist()
        of = {x: packed[a:b] for x, a, b in zip(distinct, [0, *stops], stops)}
        for w, f in zip(new, found):
            self.memo[w] = of[f[0]] if len(f) == 1 else b"".join(map(of.__getitem__, f))

    def unusual(self, text: str) -> bytes:
        """Any text, by the library's own normalizer and pre-tokenizer."""
        model, out = self.model, []
        for part in model.marks.split(text) if model.marks else [text]:
            if part in model.special:
                out.append(np.array([model.special[part]], "<u4").tobytes())
            elif part:
                split = model.pre.pre_tokenize_str(model.normalizer.normalize_str(part))
                pieces = [bytes(map(model.bytes_of.__getitem__, s)) for s, _ in split if s]
                out.append(model.merge(pieces)[0].astype("<u4").tobytes())
        return b"".join(out)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """For each text its ids, packed as little-endian unsigned 32-bit integers."""
        special = tuple(self.model.special)
        plain: list[list[str] | None] = []
        for t in texts:
            odd = t and (UNUSUAL.search(t) or any(s in t for s in special))
            plain.append(None if odd else t.lower().split() if t else [])
        out: list[bytes] = []
        for a in range(0, len(texts), STEP):
            now = plain[a : a + STEP]
            if len(self.memo) > MEMO_WORDS:
                self.memo, self.older = {}, self.memo
            self.learn(set().union(*(w for w in now if w)))
            for t, words in zip(texts[a : a + STEP], now):
                out.append(self.unusual(t) if words is None else b"".join(map(self.memo.__getitem__, words)))
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def count_tokens(path: str, limit: int = 2048):
    """A function of Arrow batches (id, text) that gives n_bytes, n_tokens and over_limit."""

    def run(batches):
        enc = encoder(path)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            n = np.fromiter((len(x) // 4 for x in enc.encode(texts)), np.int64, len(texts))
            size = np.fromiter((len(t.encode()) if t else 0 for t in texts), np.int64, len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size), pa.array(n), pa.array(n > limit)], names=["id", "n_bytes", "n_tokens", "over_limit"])

    return run


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048) -> DataFrame:
    """One row per row of ``docs``: (id, n_bytes, n_tokens, over_limit)."""
    bounded_batches(docs.sparkSession)
    kept = docs.select(quoted(id_col).cast("long").alias("id"), quoted(text_col).alias("text"))
    out = kept.mapInArrow(count_tokens(path, limit), "id long, n_bytes long, n_tokens long, over_limit boolean")
    return out.withColumnRenamed("id", id_col)
