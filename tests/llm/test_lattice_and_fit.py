"""The filter audit against every document, order and step in turn; best-fit packing against round trips and optimal packings."""

from __future__ import annotations

import random
from collections import defaultdict
from fractions import Fraction
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from clauseforge.llm import best_fit, byte_bpe, interactions
from clauseforge.llm.queries import vocabulary
from tests.llm import plain
from tests.llm.test_operators import CLASHING, SCHEMA, texts

PATH = vocabulary("byte_bpe_50k.json")
LABELS = "doc_id long, quality int, toxic int, text string, lang string, n int"


@pytest.fixture(scope="module")
def rows():
    """Odd texts, copies under other ids and languages, repeated rows, rows without an id, one text on a third of the rows."""
    lang, rng = ["en", "de", None, ""], random.Random(3)
    words = [f"w{i}" for i in range(300)]
    long = [" ".join(rng.choice(words[:90]) for _ in range(rng.randint(90, 140))) for _ in range(8)]
    long += [" ".join(rng.sample(words, 130)) for _ in range(6)] + [" ".join(rng.sample(words, 120)).upper() for _ in range(4)] + [" ".join(rng.sample(words, 120)) + " #1"] * 3
    out = [(i, t, lang[i % 4]) for i, t in enumerate(texts() + long)]
    n = len(out)
    out += [(n + i, long[i % 2], lang[i % 3]) for i in range(n // 2)]
    return out + [out[3], out[14], out[-1], out[-1], (None, long[0], "en"), (None, long[0], "en"), (None, None, "fr")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(*r, *(["x"] * len(CLASHING))) for r in rows], SCHEMA).repartition(5)


def audited(rows, labels):
    """The audit, one document, order and step after the other."""
    first, marks = {}, defaultdict(lambda: (False, False))
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    for i, q, x in labels:
        if i is not None:
            marks[i] = (marks[i][0] or q == 1, marks[i][1] or x == 1)
    out = defaultdict(lambda: [0] * 6)
    for i, t, lang in rows:
        t, w = t or "", plain.words(t)
        fails = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t), "D": any(c in "#$%&*|" for c in t), "E": i is not None and i > first[t]}
        good, toxic = marks[i] if i is not None else (False, False)
        for order in permutations("ABCDE"):
            gone = False
            for k, f in enumerate(order):
                row = out[lang or "", "".join(order), k + 1]
                here = fails[f] and not gone
                add = (not gone and not here, here, fails[f] and gone, fails[f] and sum(fails.values()) == 1, here and good, here and toxic)
                for x, a in enumerate(add):
                    row[x] += a
                gone |= fails[f]
    total = defaultdict(int)
    for (part, order, step), row in out.items():
        total[part, order[step - 1]] += row[1]
    return {k: (*row, total[k[0], k[1][k[2] - 1]]) for k, row in out.items()}


FIGURES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def test_audit_by_brute_force(spark, rows, docs):
    labels = [(i, i % 2, i % 3 % 2) for i in range(0, len(rows), 2)] + [(4, 0, 1), (4, 1, 0), (None, 1, 1), (6, None, None), (10**9, 1, 1)]
    table = spark.createDataFrame([(*x, "t", "l", 1) for x in labels], LABELS)
    got = interactions.audit(docs, table).collect()
    want = audited(rows, labels)
    assert len(got) == len(want) == 600 * 4
    assert {(r.part, r.filter_order, r.step): tuple(r[c] for c in FIGURES) for r in got} == want


def test_audit_of_nothing_and_of_other_filters(spark, docs, rows):
    labels = spark.createDataFrame([], LABELS)
    assert interactions.audit(spark.createDataFrame([], SCHEMA), labels).count() == 0
    short = {"x": lambda text, words: text == "", "y": lambda text, words: F.size(words) == 0}
    got = {(r.part, r.filter_order, r.step): r for r in interactions.audit(docs, labels, filters=short, copies=None).collect()}
    n = sum(1 for _, _, lang in rows if not lang)
    empty = sum(1 for _, t, lang in rows if not lang and not t)
    assert len(got) == 2 * 2 * 4
    assert got["", "xy", 1].kept == n - empty and got["", "xy", 1].removed == empty
    assert len(interactions.edges(5)) == 80 and len(interactions.steps(list("ABCDE"))) == 600
    assert sum(interactions.orders_through(5, s) for s, f in interactions.edges(5) if f == 4) == 120


def optimum(lengths, window):
    """Fewest sequences, by trying all."""
    best = len(lengths)

    def go(at, room):
        nonlocal best
        if len(room) >= best:
            return
        if at == len(lengths):
            best = len(room)
            return
        for r in sorted({x for x in room if x >= lengths[at]}):
            k = room.index(r)
            go(at + 1, [*room[:k], r - lengths[at], *room[k + 1 :]])
        go(at + 1, [*room, window - lengths[at]])

    go(0, [])
    return best


def test_bounds_and_best_fit():
    rng, tight = random.Random(1), 0
    for _ in range(150):
        window = rng.choice([10, 12, 30])
        lengths = sorted((rng.randint(1, window) for _ in range(rng.randint(1, 9))), reverse=True)
        bound, f = best_fit.certificate(np.bincount(lengths, minlength=window + 1))
        found, least = best_fit.best_fit(lengths, window), optimum(lengths, window)
        assert best_fit.ceil(bound) <= least <= len(found)
        assert sorted(i for s in found for i in s) == list(range(len(lengths)))
        assert all(sum(lengths[i] for i in s) <= window and sum(f[lengths[i]] for i in s) <= 1 + 1e-9 for s in found)
        assert sum(f[n] for n in lengths) == pytest.approx(float(bound))
        tight += best_fit.ceil(bound) == len(found)
    assert tight > 100
    assert best_fit.certificate(np.bincount([6] * 7, minlength=11))[0] == 7
    assert best_fit.certificate(np.bincount([4] * 6, minlength=11))[0] == 3  # two of 4 fill a window of 10
    assert best_fit.certificate(np.zeros(11, int))[0] == Fraction(0)


def test_ids_are_those_of_the_library():
    whole, enc = Tokenizer.from_file(PATH), byte_bpe.encoder(PATH)
    odd = [t for t in texts() if t] + [" " * 1_500_000, "x" * 300_000, " \n" * 700_000 + "y", "<|endoftext|><|endoftext|> a<|endoftext|>", "   　x"]
    for t in odd:
        assert enc.encode(t).tolist() == whole.encode(t, add_special_tokens=False).ids
    assert len(enc.encode(None)) == len(enc.encode("")) == 0
    with pytest.raises(ValueError):
        byte_bpe.ByteEncoder(vocabulary())


def checked(got, rows, window):
    """Pieces put together again are the documents' ids; sequences have no gap and no more than a window."""
    whole, seqs, docs = Tokenizer.from_file(PATH), defaultdict(list), defaultdict(list)
    for r in got:
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert len(ids) == r.length
        seqs[r.sequence_id].append((r.offset, r.length))
        docs[r.doc_id].append((r.piece, r.start, tuple(ids), r.doc_tokens))
    for s in seqs.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= window
    want = defaultdict(list)
    for i, t, *_ in rows:
        ids = [*whole.encode(t or "", add_special_tokens=False).ids, 0]
        cuts = [0, *range(len(ids) % window or window, len(ids) + 1, window)]
        want[i] += [(k, a, tuple(ids[a:b]), len(ids)) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    assert {k: sorted(v) for k, v in docs.items()} == {k: sorted(v) for k, v in want.items()}
    return len(seqs)


def test_packing_round_trip(spark, rows, docs):
    for window in (2048, 64):
        packed, figures = best_fit.certified(docs, PATH, window=window)
        got = packed.collect()
        n = checked(got, rows, window)
        full = sum(r.length == window for r in got)
        sequences, bound = figures[-1]
        assert n == sequences + full and sequences <= figures[0][0]
        lengths = [r.length for r in got if r.length < window]
        assert bound <= sequences <= len(best_fit.best_fit(lengths, window)) * 1.02 + 1


def test_exchange_meets_the_bound(spark):
    """Forty tasks of a few documents each leave forty sequences half empty; the exchange fills them."""
    rng = random.Random(9)
    made = [(i, " ".join(rng.choice(["alpha", "beta", "gamma"]) for _ in range(rng.randint(5, 300)))) for i in range(600)]
    d = spark.createDataFrame(made, "doc_id long, text string").repartition(40)
    _, figures = best_fit.certified(d, PATH)
    assert figures[0][0] >= figures[0][1] + 10
    assert figures[-1][0] <= figures[-1][1] + 1


def test_packing_of_nothing(spark):
    packed, figures = best_fit.certified(spark.createDataFrame([], SCHEMA), PATH)
    assert packed.count() == 0 and figures == [(0, 0)]
    assert packed.columns == ["doc_id", "piece", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]


def test_blocks_are_bounded():
    p = best_fit.Packer(0, 64, pieces=50, tokens=1 << 20)
    for i in range(500):
        p.add((i, 0, 0, 1 + i % 63, b"", 1 + i % 63))
        assert len(p.held) < 50
    p.pack()
    assert len(p.rows) == 500
