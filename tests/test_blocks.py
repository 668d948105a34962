"""Search over blocks of postings and over vectors, against every score at once."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from clauseforge.operators import blocks as K
from clauseforge.operators import index as I
from clauseforge.operators import retrieval as R


def texts(n):
    """Common words everywhere, rare ones here and there, repeated and empty chunks; positions with gaps."""
    rng = random.Random(4)
    rare = [f"rare{i}" for i in range(60)]
    out = [(i * 3 if i < n // 2 else i * 3 + 5000, " ".join(rng.choices(["pump", "valve", "motor", "oil"], k=rng.randint(1, 40)) + rng.sample(rare, rng.randint(0, 3)))) for i in range(n)]
    return [*out, (1, ""), (4, out[0][1]), (7, out[0][1]), (10, "pump " * 3000)]


@pytest.fixture(scope="module")
def held(spark):
    chunks = spark.createDataFrame(texts(400), "pos long, indexed string").repartition(5)
    tables = {n: t.cache() for n, t in I.tables(chunks).items()}
    return tables | {"blocks": K.blocked(tables["postings"]).cache()}


@pytest.fixture(scope="module")
def questions(spark):
    rng = random.Random(8)
    asked = [(i, " ".join(rng.sample(["pump", "valve", "motor", "oil", "nothing"], 3) + [f"rare{rng.randint(0, 70)}"])) for i in range(40)]
    return spark.createDataFrame([*asked, (90, ""), (91, "unheard of"), (92, "pump"), (93, "pump")], "qid long, question string")


def rows(df):
    return sorted((r.qid, r["rank"], r.pos, round(r.score, 8)) for r in df.collect())


@pytest.mark.parametrize("k", [1, 5, 1000])
def test_blocks_find_what_a_join_finds(held, questions, k):
    whole = {n: t for n, t in held.items() if n != "blocks"}
    got = rows(R.bm25_search(held["chunks"], questions, k, tables=held))
    assert got == rows(R.bm25_search(whole["chunks"], questions, k, tables=whole))
    assert {q for q, *_ in got} == {*range(40), 92, 93}
    named = questions.select(F.concat(F.lit("q"), "qid").alias("qid"), "question")
    assert [(f"q{q}", *x) for q, *x in got] == sorted((rows(R.bm25_search(held["chunks"], named, k, tables=held))), key=lambda r: (int(r[0][1:]), r[1]))


def test_expansions_and_large_sets_of_questions(held, questions, monkeypatch):
    more = questions.where("qid < 20").select("qid", F.lit("rare1 oil").alias("expansion"))
    got = rows(R.bm25_search(held["chunks"], questions, 7, more, tables=held))
    monkeypatch.setattr(R, "ASKED_TERMS", 3)
    assert got == rows(R.bm25_search(held["chunks"], questions, 7, more, tables=held))
    assert got != rows(R.bm25_search(held["chunks"], questions, 7, tables=held))


def test_blocks_hold_all_postings(held):
    got = []
    for r in held["blocks"].collect():
        sizes, docs, tf = np.frombuffer(r.sizes, np.int32), np.frombuffer(r.docs, np.uint8), np.frombuffer(r.tf, np.uint32)
        lengths = np.frombuffer(r.dl, np.int64)
        assert len(set(r.terms)) == len(r.terms) == len(sizes)
        for t, d, f in zip(np.repeat(r.terms, sizes), docs, tf):
            got.append((r.block * K.BLOCK + int(d), int(lengths[d]), str(t), int(f)))
    assert len({r.block for r in held["blocks"].select("block").collect()}) == held["blocks"].count()
    assert sorted(got) == sorted((r.pos, r.dl, r.term, r.tf) for r in held["postings"].collect())


def test_blocks_that_cannot_reach_the_best_are_passed_over(held, questions):
    """A block whose bound lies below what is asked for gives nothing, and bounds hold for every chunk."""
    asked = K.Asked(held["terms"].join(R.query_terms(questions), "term").select("qid", "term", (F.col("w") * F.col("idf")).alias("weight")).toArrow())
    avgdl = held["stats"].first().avgdl
    import pyarrow as pa

    for r in held["blocks"].collect():
        row = {n: r[n] for n in K.NAMES} | {"terms": pa.array(r.terms)}
        question, pos, score = K.block_scores(asked, row, avgdl, R.K1, R.B, np.full(len(asked.ids), -np.inf))
        top = np.zeros(len(asked.ids))
        np.maximum.at(top, question, score)
        q2, p2, s2 = K.block_scores(asked, row, avgdl, R.K1, R.B, top)
        kept = dict(zip(zip(q2, p2), s2))
        assert all(kept[q, p] == s for q, p, s in zip(question, pos, score) if s == top[q])
        assert not len(K.block_scores(asked, row, avgdl, R.K1, R.B, np.full(len(asked.ids), 1e9))[0])


def test_nothing_to_search(spark, held):
    none = spark.createDataFrame([], "qid long, question string")
    assert R.bm25_search(held["chunks"], none, 5, tables=held).count() == 0
    assert K.blocked(held["postings"].limit(0)).count() == 0


@pytest.mark.parametrize("values", [64, 1 << 22])
def test_dense_search_in_one_pass_and_in_several(spark, monkeypatch, values):
    rng = np.random.default_rng(2)
    x = np.round(rng.standard_normal((300, 8)), 1)
    x[100:140] = x[0]  # ties
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "pos long, vector array<double>").repartition(3)
    q = spark.createDataFrame([(str(i), x[i].tolist()) for i in range(0, 40)], "qid string, vector array<double>")
    monkeypatch.setattr(R, "QUERY_VALUES", values)
    monkeypatch.setattr(R, "QUERY_BLOCK", 7)
    got = {(r.qid, r["rank"]): r.pos for r in R.dense_search(v, q, 12).collect()}
    want = {}
    for i in range(40):
        order = sorted(range(300), key=lambda p: (-round(float(x[i] @ x[p]), 9), p))[:12]
        want |= {(str(i), n + 1): p for n, p in enumerate(order)}
    assert got == want
    assert R.dense_search(v, q.limit(0), 3).count() == R.dense_search(v.limit(0), q, 3).count() == 0
