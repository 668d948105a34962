"""Batches of chunks against tokens, postings and scores made by expressions and joins."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from clauseforge.functions import text as T
from clauseforge.operators import batches as B
from clauseforge.operators import index as I
from clauseforge.operators import retrieval as R

HOSTILE = ["", None, "the of and", "A-b a-b a.b.cc -x- x..y x-.y", "the-valve no.of the", "İstanbul Kelvin K3-K ß Ä-x é1", "x" * 5000 + "-" + "y" * 5000, "a-a-a aa-aa aa", "1.2.3 v1.2-rc1 1.2.3", "\x00nul-byte\x00 a_b", "Σας ΣΑΣ ｆｕｌｌ"]


@pytest.fixture(scope="module")
def chunks(spark):
    rng = random.Random(3)
    words = ["pump", "valve", "motor-x", "oil", "re.d", "The", "of"] + [f"rare{i}" for i in range(40)]
    texts = HOSTILE + [" ".join(rng.choices(words, k=rng.randint(0, 60))) for _ in range(300)]
    return spark.createDataFrame([(i * 7, t) for i, t in enumerate(texts)], "pos long, indexed string").repartition(3)


@pytest.fixture(scope="module")
def questions(spark):
    rng = random.Random(5)
    rows = [(i, f"pump the {rng.choice(['oil', 're.d', 'motor-x'])} rare{rng.randint(0, 60)} pump") for i in range(30)]
    return spark.createDataFrame([*rows, (90, ""), (91, "unheard of")], "qid long, question string")


def test_batches_hold_the_tokens_of_chunks(chunks, monkeypatch):
    monkeypatch.setattr(B, "CHUNKS", 16)
    want = {r.pos: r.t for r in chunks.select("pos", T.tokens("indexed").alias("t")).collect()}
    posts = I.tables(chunks)["postings"].collect()
    got: dict = {}
    for r in posts:
        assert r.dl == len(want[r.pos]) and (r.pos, r.term) not in got
        got[r.pos, r.term] = r.tf
    assert got == {(p, t): n for p, ts in want.items() for t, n in Counter(ts or []).items()}


def test_tables_are_those_of_postings(chunks):
    held = I.tables(chunks)
    posts, stats = I.postings(chunks), I.corpus_stats(chunks)
    assert held["stats"].collect() == stats.select("n", "avgdl").collect()
    assert sorted(held["terms"].collect()) == sorted(I.term_stats(posts, stats).collect())
    weights = {(r.pos, r.term): r.w for r in I.tfidf(posts, stats).collect()}
    assert {(r.pos, r.term): r.w for r in held["weights"].collect()} == pytest.approx(weights)


def test_searches_find_what_joins_find(chunks, questions, monkeypatch):
    held = I.tables(chunks)
    joined = {n: t for n, t in held.items() if n not in ("batches", "weighed")}
    rows = lambda df: sorted((r.qid, r["rank"], r.pos, round(r.score, 8)) for r in df.collect())
    for search in (R.bm25_search, R.tfidf_search):
        got = rows(search(chunks, questions, 9, tables=held))
        assert got == rows(search(chunks, questions, 9, tables=joined)) == rows(search(chunks, questions, 9)) and len(got) > 200
        monkeypatch.setattr(R, "ASKED_TERMS", 3)
        assert got == rows(search(chunks, questions, 9, tables=held))
        monkeypatch.undo()


def test_no_posting_is_shuffled(chunks, questions):
    held = I.tables(chunks)
    asked = held["terms"].join(R.query_terms(questions), "term").select("qid", "term", (F.col("w") * F.col("idf")).alias("weight"))
    found = B.search(held["batches"], asked, 5, B.bm25(20.0, R.K1, R.B), ["dl"])
    for df in (B.made(chunks.coalesce(1), "indexed"), found):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Exchange hashpartitioning" not in plan and "SortMergeJoin" not in plan


def test_few_sums_at_once(chunks, questions, monkeypatch):
    from clauseforge.operators import blocks

    table = R.query_terms(questions).select("qid", "term", F.col("w").alias("weight")).toArrow()
    row = B.made(chunks.coalesce(1), "indexed").first()
    asked, read = blocks.Asked(table), lambda name, kind: np.frombuffer(row[name], kind)
    import pyarrow as pa

    def scores():
        gain = lambda at: read("tf", np.uint32)[at].astype(float)
        return [x.tolist() for x in blocks.scores(asked, pa.array(row["terms"]), read("sizes", np.int32), read("docs", np.int32), gain, row["n"], np.full(len(asked.ids), -np.inf))]

    want = scores()
    monkeypatch.setattr(blocks, "CELLS", row["n"] * 4)
    assert scores() == want


def test_blocks_of_batches_are_those_of_postings(chunks, monkeypatch):
    from clauseforge.operators import blocks

    monkeypatch.setattr(B, "CHUNKS", 50)  # a block's chunks lie in several batches
    held = I.tables(chunks)
    rows = lambda df: {r.block: (r.terms, *map(bytes, (r.sizes, r.docs, r.tf, r.dl))) for r in df.collect()}
    got = rows(blocks.of_batches(held["batches"]))
    assert got == rows(blocks.blocked(held["postings"])) and len(got) > 10


def test_rows_of_latent_vectors_are_made_in_batches(chunks):
    from clauseforge.operators import latent

    held = I.tables(chunks)
    of = latent.columns(held["weights"])
    assert latent.columns(None, terms=held["kept"]).collect() == of.collect()
    names = of.sort("f").select("term").toArrow()["term"].combine_chunks()
    rows = lambda df: {r.pos: [(e.f, pytest.approx(e.w, abs=1e-12)) for e in r.r] for r in df.collect()}
    for limit, columns, terms in ((1 << 17, of, names), (7, None, None)):  # hashed columns are shared by several terms
        made = B.entries(held["weighed"], limit, terms, lambda t: latent.slot(limit, t), latent.sign)  # noqa: B023
        plan = made._jdf.queryExecution().executedPlan().toString()
        got, want = {r.pos: [(e.f, e.w) for e in r.r] for r in made.collect()}, rows(latent.entries(held["weights"], columns, limit))
        assert got == want and len(got) > 250 and plan.count("collect_list") == 0


def test_chunks_that_have_a_term(chunks):
    import pyarrow as pa

    held, asked = I.tables(chunks), ["rare3", "oil", "re.d", "unheard"]
    got = sorted((r.pos, r.term) for r in B.having(held["batches"], pa.array(asked)).collect())
    assert got == sorted((r.pos, r.term) for r in held["postings"].where(F.col("term").isin(asked)).collect()) and len(got) > 50
    assert B.having(held["batches"], pa.array([], pa.string())).count() == 0


def test_expected_reads_the_index(spark, tmp_path):
    """Questions met verbatim: with tokens, without, of two words, with a null source beside; each text is tokenised once."""
    from clauseforge.plans import answering as P
    from clauseforge.plans.search import chunks as of

    texts = ["say The pump-3 shall stop now ok", "The pump-3 shall stop nowhere", "x of the and on y", "é ü ö", "oil valve", None, "The pump-3 shall"]
    rows = [(i, t, "en", f"s{i}", len(t or "")) for i, t in enumerate(texts)] + [(90, texts[0], None, "n", 9), (91, texts[2], "en", None, 9)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    asked = ["The pump-3 shall stop now", "of the and on", "é ü ö", "oil valve", "", "no such words here", None]
    spark.createDataFrame(list(enumerate(asked)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    held = I.tables(of(spark, str(tmp_path)))
    found = P.expected(spark, str(tmp_path), held)
    want = {(q, s, lang) for q, x in enumerate(asked) if x is not None for _, t, lang, s, _ in rows if t is not None and x in t}
    assert {tuple(r) for r in found.collect()} == want and len(want) > 10
    assert "Generate explode(array_distinct(split" not in found._jdf.queryExecution().toString()


def test_terms_of_batches_are_counted_in_shares(chunks, monkeypatch):
    """Frequencies of several shares and batches are those of postings; terms are sent many to a row, and batches meet them without a join of terms."""
    monkeypatch.setattr(B, "CHUNKS", 16)
    monkeypatch.setattr(B, "TOGETHER", 4)
    held = I.tables(chunks)
    batches, counted = held["batches"].count(), held["counted"]
    want = {r.term: r.df for r in held["postings"].groupBy("term").agg(F.count("*").alias("df")).collect()}
    assert {r.term: r.df for r in held["terms"].collect()} == want and batches >= 20
    assert counted.where("batch IS NULL").count() > 1 and counted.count() < batches * (batches / 4 + 2)
    places = {r.batch: {} for r in counted.where("batch IS NOT NULL").collect()}
    for r in counted.where("batch IS NOT NULL").collect():
        places[r.batch] |= dict(zip(np.frombuffer(r.at, np.int32).tolist(), np.frombuffer(r.df, np.int64).tolist()))
    for r in held["batches"].collect():
        assert [places.get(r.batch, {})[i] for i in range(len(r.terms))] == [want[t] for t in r.terms]
    plan = held["weighed"]._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Join" not in plan


def test_words_are_those_of_the_pattern():
    """Marks at ends, doubled and between texts, zero bytes, letters whose lower case is ASCII; without a Python object a word."""
    import re

    pattern, rng = re.compile(T.TOKEN.encode()), random.Random(1)
    parts = ["a", "B", "9", "-", ".", " ", "\x00", "é", "İ", "K", "ß", "_", "Σ", "--", "a-b", "x.Y-3"]
    for _ in range(300):
        texts = [None if rng.random() < 0.1 else "".join(rng.choices(parts, k=rng.randint(0, 12))) for _ in range(rng.randint(1, 6))]
        words, of = B._words([None if t is None else t.encode() for t in texts])
        assert list(zip(of.tolist(), words.to_pylist())) == [(i, w) for i, t in enumerate(texts) if t for w in pattern.findall(t.lower().encode())]


def test_only_terms_of_questions_leave_the_vocabulary(spark, chunks, questions, monkeypatch):
    """What is joined with the questions' terms is a part of the vocabulary that grows with them; results are those of the whole."""
    terms = I.tables(chunks)["terms"]
    asked = {r.term for r in R.distinct_terms(questions).collect()}
    idf = {r.term: r.idf for r in terms.collect()}
    want = {}
    for r in R.distinct_terms(questions).collect():
        want.setdefault(r.qid, []).append((r.ord, r.term, idf.get(r.term, R.UNKNOWN_IDF)))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for few in (True, False):
            if not few:
                monkeypatch.setattr(R, "sized", lambda df: df)
            found = R.weighted_terms(questions, terms)
            assert {r.qid: [tuple(t) for t in r.terms] for r in found.collect()} == {q: sorted(t) for q, t in want.items()}
            plan = found._jdf.queryExecution().optimizedPlan().toString()
            assert plan.index("LeftSemi") > plan.index("LeftOuter") and len(idf) > len(asked & set(idf)) > 5
            if few:
                assert "BroadcastHashJoin [term" in found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_stored_rows_lie_in_small_row_groups(spark):
    """A writer holds a row group, a reader loads one: neither grows with the rows of a task."""
    import pyarrow.parquet as pq

    from clauseforge.session import stored

    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    rows = spark.range(24).coalesce(1).select("id", F.expr("repeat(uuid(), 14000)").cast("binary").alias("data"))
    held = stored(rows, 1 << 20)
    (file,) = held.inputFiles()
    groups = pq.ParquetFile(file.removeprefix("file://")).metadata
    assert max(groups.row_group(i).num_rows for i in range(groups.num_row_groups)) <= 6
    assert held.count() == 24 and spark.conf.get(name, None) == before


def test_a_worker_gets_few_batches_at_once(chunks, questions, monkeypatch):
    """Searches bound what they send to a worker, whatever the session allows, and leave the setting as it was."""
    monkeypatch.setattr(B, "CHUNKS", 16)
    monkeypatch.setattr(B, "BYTES", 1)
    held = I.tables(chunks)
    asked = R.query_terms(questions).select("qid", "term", F.col("w").alias("weight"))

    def gain(part, i, tf, docs):
        assert part.num_rows == 1, f"{part.num_rows} batches at once"
        return tf

    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = chunks.sparkSession.conf.get(name, None)
    assert held["batches"].count() > 5
    assert B.search(held["batches"].coalesce(1), asked, 5, gain, ["dl"]).count() > 0
    assert chunks.sparkSession.conf.get(name, None) == before


def test_searches_shuffle_nothing_before_they_are_settled(chunks, questions, monkeypatch):
    """The plan that is run at once reads the batches where they lie."""
    held, plans = I.tables(chunks), []
    monkeypatch.setattr(B, "settled", lambda df, batch_bytes: plans.append((df._jdf.queryExecution().executedPlan().toString(), batch_bytes)) or df)
    asked = R.query_terms(questions).select("qid", "term", F.col("w").alias("weight"))
    B.search(held["batches"], asked, 5, B.bm25(9.0, R.K1, R.B), ["dl"])
    ((plan, batch_bytes),) = plans
    assert "MapInArrow" in plan and "Exchange" not in plan and batch_bytes == B.BYTES
