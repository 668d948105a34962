"""Near copies against all pairs, alone and as a stage of the pipeline."""

from __future__ import annotations

import random
import time
from pathlib import Path
from urllib.parse import urlparse

import corpus_pipeline as P
import numpy as np
import pytest
from clauseforge.llm import near_copies
from clauseforge.llm.common import cut, passing
from tests.llm import plain
from tests.llm.test_operators import check_pieces
from tests.llm.test_pipeline import fixture, plain_secrets


def shingles(t):
    w = [x.lower() for x in plain.words(t)]
    n = min(5, len(w))
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if w else set()


def least(rows):
    """id -> least id that links of similarity 0.8 lead to."""
    sets, top = {i: shingles(t) for i, t in rows}, {i: i for i, _ in rows}
    for a in sorted(sets):
        for b in sorted(sets):
            x, y = sets[a], sets[b]
            if a < b and (x == y or 5 * len(x & y) >= 4 * len(x | y)):
                u, v = top[a], top[b]
                top = {i: min(u, v) if r in (u, v) else r for i, r in top.items()}
    return top


def edited(rng, text, n):
    w = text.split()
    for k in rng.sample(range(len(w)), n):
        w[k] = f"e{rng.randrange(10**6)}"
    return " ".join(w)


@pytest.mark.parametrize("options", [{}, {"hot": 8, "block": 4}, {"long": 1000}])
def test_planted_edits(spark, options, monkeypatch):
    options = dict(options)
    if long := options.pop("long", None):  # few shingles make a text a long one
        monkeypatch.setattr(near_copies, "BLOCK_SHINGLES", long)
    rng = random.Random(4)
    prose = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(rng.randint(120, 300))) for _ in range(12)]
    rows = list(enumerate([*prose, "", None, "one", "two words", "Two  Words"]))
    rows += [(100 + i, edited(rng, t, n)) for i, (t, n) in enumerate((t, n) for t in prose for n in (1, 2, 3, 4, 8, 20))]
    rows += [(300 + i, edited(rng, prose[0], rng.randint(1, 2))) for i in range(30)]
    top = least(rows)
    kept = near_copies.deduplicated(spark.createDataFrame([*rows, (None, prose[0]), (None, prose[0])], "doc_id long, text string"), **options).collect()
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == sorted(set(top.values())) and len(kept) == len(set(top.values())) + 2
    assert len(set(top.values())) < len(rows) - 60


def test_prefixes_lose_no_link(spark):
    """Sets around the threshold, many with a template in common: links by prefixes span what all pairs link."""
    rng = random.Random(9)
    token = lambda: rng.getrandbits(63)
    template = [token() for _ in range(80)]
    sets = [{*template, *(token() for _ in range(rng.randint(0, 45)))} for _ in range(60)] + [{token() for _ in range(n)} for n in (1, 1, 2, 4, 5, 9, 100)]
    for s in list(sets):
        for n in (1, 2, len(s) // 9, len(s) // 8, len(s) // 5):
            sets.append({*rng.sample(sorted(s), max(len(s) - n, 1)), *(token() for _ in range(rng.choice([0, 0, n])))})
    sets = [sorted(s) for s in {frozenset(s) for s in sets}]
    rows = [(k, bytes(np.array(s, np.uint64))) for k, s in enumerate(sets)]
    held = spark.createDataFrame(rows, "cls long, s binary")
    root = {k: min(k, k - k % 3) if k < 60 else k for k in range(len(sets))}  # some are linked before
    found = spark.createDataFrame([(k, r) for k, r in root.items() if k != r], "a long, b long")
    classes = spark.createDataFrame([(k, root[k], len(s)) for k, s in enumerate(sets)], "cls long, root long, size long")
    alike = lambda a, b: near_copies.alike(np.array(sets[a], np.uint64), np.array(sets[b], np.uint64))

    def parts(links):
        top = dict(root)
        for a, b in links:
            u, v = top[a], top[b]
            top = {i: min(u, v) if r in (u, v) else r for i, r in top.items()}
        return top

    got = [(r.a, r.b) for r in near_copies.prefix_links(classes, held, found).collect()]
    assert all(alike(a, b) for a, b in got)
    want = parts([(a, b) for a in range(len(sets)) for b in range(a) if alike(a, b)])
    assert parts(got) == want and len(set(want.values())) < len(set(root.values())) - 40


def test_template_grows_with_documents(spark, monkeypatch):
    """Documents with a template in common that are not alike meet at no shingle: four times as many make four times the work."""
    compared, took = [], []
    true = near_copies.verified
    monkeypatch.setattr(near_copies, "verified", lambda pairs, sets: compared.append(pairs.count()) or true(pairs, sets))
    rng = random.Random(5)
    template = " ".join(f"t{k}" for k in range(400))
    for n in (1000, 4000):
        rows = [(k, template + " " + " ".join(f"w{rng.randrange(10**9)}" for _ in range(rng.randint(60, 100)))) for k in range(n)]
        rows += [(n + k, t + " more") for k, (_, t) in enumerate(rows[:50])]
        begun = time.time()
        kept = near_copies.deduplicated(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
        assert {r.doc_id for r in kept.select("doc_id").collect()} == set(range(n))
        took.append(time.time() - begun)
    assert max(compared) <= 100, compared
    assert took[1] < 6 * took[0] + 10, took


def test_stages_with_near_copies(spark, tmp_path):
    rows, items = fixture()
    docs = spark.createDataFrame([(i, t, len(t or "")) for i, t in rows], "doc_id long, text string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    want = {i: q[3] for i, t in rows if (q := plain.quality(t))[2]}
    top = least(list(want.items()))
    want = {i: t for i, t in want.items() if top[i] == i}
    leaks = lambda t: any(len((s := plain.shingles(x)) & plain.shingles(t)) / len(s) >= 0.8 for _, x in items)
    want = {i: plain_secrets(t) for i, t in want.items() if not leaks(t)}
    got = P.run(spark, str(tmp_path)).collect()
    check_pieces(got, list(want.items()))
    assert {p.doc_id for p in got} == set(want)


def test_run_leaves_no_checkpoints(spark, tmp_path):
    docs, items = fixture()
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    kept = cut(spark.range(3))  # outside of a stage: stays
    folder = Path(urlparse(spark.sparkContext._jsc.sc().getCheckpointDir().get()).path)
    before = sorted(folder.iterdir())
    assert before and P.run(spark, str(tmp_path)).count() > 0
    assert sorted(folder.iterdir()) == before and kept.count() == 3
    with pytest.raises(ValueError), passing(spark):
        cut(spark.range(3))
        raise ValueError
    assert sorted(folder.iterdir()) == before


def test_different_sets_of_one_hash_are_told_apart(spark):
    schema = "id long, cls long, check long"
    rows = [(1, 7, 1), (2, 7, 1), (3, 7, 2), (4, 8, 1)]
    got = {r.id: r.cls for r in near_copies.told_apart(spark.createDataFrame(rows, schema)).collect()}
    assert got[1] == got[2] != got[3] and got[4] == 8 and len(set(got.values())) == 3
    assert near_copies.told_apart(spark.createDataFrame(rows[3:], schema)).collect() == [(4, 8, 1)]


def test_shards_are_searched_by_bk_trees(monkeypatch):
    """The links of a shard are those that its tree finds, and no fewer than comparing all pairs gives."""
    import random

    from clauseforge.llm import near_copies as N
    from clauseforge.llm.simhash import BKTree, majority

    rng = random.Random(6)
    base = [[f"w{rng.randint(0, 999)}" for _ in range(120)] for _ in range(12)]
    words = base + [[*b[:100], f"x{k}", *b[101:]] for b in base for k in range(3)] + [base[0] + ["w1"], base[0] + ["w1"]]
    sets = [N.shingles(" ".join(w)) for w in words]
    prints = [majority(s.astype(">u8").view(np.uint8).reshape(-1, 8)) for s in sets]
    held = [(i, i, int(np.uint64(p).view(np.int64)), s.tobytes()) for i, (p, s) in enumerate(zip(prints, sets))]

    def parts(links):
        top = list(range(len(sets)))
        for a, b in links:
            top = [top[a] if t == top[b] else t for t in top]
        return [top.index(t) for t in top]

    pairs = [(x, y) for x in range(len(sets)) for y in range(x) if (prints[x] ^ prints[y]).bit_count() <= N.RADIUS and N.alike(sets[x], sets[y])]
    asked, within = [], BKTree.within
    monkeypatch.setattr(BKTree, "within", lambda self, x, radius: asked.append(radius) or within(self, x, radius))
    assert parts(N.unit_links(held)) == parts(pairs) and pairs
    assert asked == [N.RADIUS] * (len(held) - 1)
