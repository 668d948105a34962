"""What is plugged into the engine takes effect; settings, evaluation, service and fetcher."""

from __future__ import annotations

import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from clauseforge import cli, service
from clauseforge.config import Guard, Retrieval, Settings, load_env
from clauseforge.engine import Engine
from clauseforge.operators import answers as A
from clauseforge.operators import index as I
from clauseforge.operators import latent as L
from clauseforge.operators import plugins as P
from clauseforge.operators import retrieval as R
from clauseforge.session import settled
from clauseforge.sources import archives, store
from tests.test_engine import MANUAL, ask, index, parts  # noqa: F401

QUESTION = "When does the pump control unit start timer T4410?"


class Backwards(P.Reranker):
    """Prefers passages on colours, whatever is asked."""

    name = "backwards"

    def score(self, pairs):
        return pairs.select("qid", "pos", F.when(F.col("passage").contains("Colours"), 0.9).otherwise(0.3).alias("score"))


def test_reranker_decides_the_order(spark, index):  # noqa: F811
    engine = Engine(spark, index, reranker=Backwards())
    hits = engine.retrieve(ask(spark, QUESTION + " hot pumps")).sort("rank").collect()
    assert hits[0].clause == "A" and hits[0].score == 0.9 and hits[1].score == 0.3
    plain = Engine(spark, index, Settings(retrieval=Retrieval(reranker="none"))).retrieve(ask(spark, QUESTION)).sort("rank").collect()
    assert plain[0].score == 1.0 and plain[0].clause == "3.1"
    with pytest.raises(ValueError):
        Engine(spark, index, Settings(retrieval=Retrieval(reranker="unheard of")))


def test_settings_reach_the_gate_and_fusion(spark, index):  # noqa: F811
    strict = Engine(spark, index, Settings(guard=Guard(min_top=1.01))).ask(ask(spark, QUESTION))
    assert strict["answers"].first().abstained and "below 1.01" in strict["answers"].first().reason
    wide = Engine(spark, index, Settings(retrieval=Retrieval(rrf_k=1))).retrieve(ask(spark, QUESTION)).sort("rank").first()
    assert abs(wide.fusion - 1.0) < 1e-9  # first in both lists
    assert Engine(spark, index).retrieve(ask(spark, QUESTION), k=1).count() == 1
    sig = spark.createDataFrame([(1, 0.5, 0.1, 0.05, 3)], "qid long, top double, support double, overlap double, hits long")
    assert not A.gate(sig).first().answerable and A.gate(sig, min_overlap=0.01).first().answerable


class Judge(P.LanguageModel):
    name = "judge"

    def complete(self, system, prompt):
        if "CLAIMS" in prompt:
            lines = prompt.split("CLAIMS:\n")[1].splitlines()
            return "\n".join(f"{x.split(':')[0]}: {'NOT_SUPPORTED' if 'safety' in x else 'SUPPORTED'}" for x in lines)
        return "The unit starts timer T4410 when the pressure falls below 12 bar. [S1]\nAfter expiry of timer T4410 the operator shall run the restart safety procedure within 30 seconds. [S1]"


def test_entailment(spark, index):  # noqa: F811
    engine = Engine(spark, index, llm=Judge())
    without = engine.ask(ask(spark, QUESTION))["answers"].first()
    found = engine.ask(ask(spark, QUESTION), entailment=True)
    assert without.kept == 2 and found["answers"].first().kept == 1 and "safety" not in found["answers"].first().answer
    assert {r.claim_no: r.entailment for r in found["claims"].collect()} == {0: "SUPPORTED", 1: "NOT_SUPPORTED"}
    with pytest.raises(ValueError):
        Engine(spark, index).ask(ask(spark, QUESTION), entailment=True)


def test_models_by_name(monkeypatch):
    for name in ("GROQ_API_KEY", "OPENAI_API_KEY", "CLAUSEFORGE_MODEL"):
        monkeypatch.delenv(name, raising=False)
    assert P.resolve(P.MODELS, "none") is None and P.resolve(P.MODELS, "auto") is None
    monkeypatch.setenv("OPENAI_API_KEY", "k")
    found = P.resolve(P.MODELS, "auto")
    assert (found.key, found.kind) == ("k", "openai") and P.resolve(P.MODELS, "ollama").kind == "ollama"
    with pytest.raises(ValueError):
        P.resolve(P.MODELS, "other")


def dense_rows(weights, limit):
    """TF-IDF rows as a plain matrix over the columns."""
    of = L.columns(weights, limit)
    rows = {r.pos: r.r for r in L.entries(weights, of, limit).collect()}
    dense = np.zeros((max(rows) + 1, limit if of is None else of.count()))
    for pos, entries in rows.items():
        for e in entries:
            dense[pos, e.f] = e.w
    return dense


@pytest.mark.parametrize("limit", [1 << 17, 16])
def test_latent_vectors_against_a_plain_decomposition(spark, limit):
    """Over the kept terms, and over hashed columns where there are more terms than columns."""
    rng = np.random.default_rng(3)
    words = [f"t{i}" for i in range(40)]
    texts = [" ".join(rng.choice(words[(k % 4) * 10 : (k % 4) * 10 + 12], 15)) for k in range(60)]
    chunks = spark.createDataFrame(list(enumerate(texts)), "pos long, indexed string").repartition(3)
    stats = I.corpus_stats(chunks)
    weights = I.tfidf(I.postings(chunks), stats).cache()
    dense = dense_rows(weights, limit)
    assert dense.shape[1] == min(limit, 40)
    x = rng.standard_normal((dense.shape[1], 5))
    assert np.abs(L.times(L.entries(weights, L.columns(weights, limit), limit), x) - dense.T @ (dense @ x)).max() < 1e-4
    vectors, basis = I.latent_vectors(weights, dims=8, limit=limit)
    got = np.array([r.vector for r in vectors.sort("pos").collect()])
    u, s, vt = np.linalg.svd(dense, full_matrices=False)
    plain = dense @ vt[:8].T
    plain /= np.linalg.norm(plain, axis=1, keepdims=True)
    assert got.shape == (60, 8) and np.abs(got @ got.T - plain @ plain.T).max() < 1e-3
    terms = I.term_stats(I.postings(chunks), stats)
    asked = I.encoded(spark.createDataFrame([(0, texts[7])], "qid long, question string"), terms, stats, basis).first().vector
    assert abs(np.dot(asked, got[7]) - 1) < 1e-6


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no tables here")
def test_latent_vectors_of_the_tables(spark):
    """256 dimensions over all kept terms of 1,000 documents, whose singular values fall slowly."""
    from clauseforge.plans.search import chunks

    weights = settled(I.tables(chunks(spark, "/root/testdata/sf0.01"))["weights"])
    of = L.columns(weights)
    rows, m = settled(L.entries(weights, of)), of.count()
    basis, sigma = L.leading(rows, m, 256)
    dense = dense_rows(weights, L.MAX_COLUMNS)
    plain = np.sqrt(np.maximum(np.linalg.eigvalsh(dense @ dense.T)[::-1], 0))
    assert m > 20_000 and np.abs(basis.T @ basis - np.eye(256)).max() < 1e-4
    assert abs((sigma**2).sum() / (plain[:256] ** 2).sum() - 1) < 3e-3  # the 256th value is 1.045, the 300th 1.03: as good as tied
    assert np.abs(sigma[:32] / plain[:32] - 1).max() < 1e-3
    assert abs(((dense @ basis) ** 2).sum() / (sigma**2).sum() - 1) < 1e-3


def test_latent_vectors_of_little(spark):
    none = spark.createDataFrame([], "pos long, term string, w double")
    vectors, basis = I.latent_vectors(none)
    assert vectors.count() == basis.count() == 0
    same = spark.createDataFrame([(i, t, 0.6 if t == "a" else 0.8) for i in range(4) for t in "ab"], "pos long, term string, w double")
    vectors, _ = I.latent_vectors(same)  # of rank one: the second dimension is zero
    assert [[round(abs(x), 6) for x in r.vector] for r in vectors.collect()] == [[1.0, 0.0]] * 4


def test_stored_vectors_are_used(spark, index):  # noqa: F811
    engine = Engine(spark, index)
    assert engine.indexed == "latent" and engine.vectors.count() == 4
    hits = engine.retrieve(ask(spark, "timer T4410 pressure"), "dense", rerank=False).sort("rank").collect()
    assert hits[0].clause == "3.1"

    class First(P.Embeddings):
        name = "first"

        def passages(self, chunks):
            return chunks.select("pos", F.array(F.when(F.col("clause") == "1", 1.0).otherwise(0.0)).alias("vector"))

        def questions(self, questions):
            return questions.select("qid", F.array(F.lit(1.0)).alias("vector"))

    assert Engine(spark, index, embeddings=First()).retrieve(ask(spark, "timer"), "dense", rerank=False).sort("rank").first().clause == "1"


def test_diagnostics(spark, index):  # noqa: F811
    got = {r.qid: r for r in Engine(spark, index).diagnostics(ask(spark, "RSP in clause 3.1 of TS 11.222", "zebra quokka")).collect()}
    assert (got[0].expansions, got[0].specs, got[0].clauses) == (["Restart Safety Procedure"], ["11.222"], ["3.1"])
    assert got[0].pinned == 1 and got[0].bm25 >= 1 and got[0].candidates >= got[0].dense and got[0].hits >= 1
    assert (got[1].bm25, got[1].hits) == (0, 0)


GOLDEN = [
    {"id": "g1", "question": QUESTION, "expect_specs": ["11.222"], "expect_clauses": ["3"], "must_include": ["T4410"], "must_not_include": ["T9"]},
    {"id": "g2", "question": "What does TS 99.999 say about pumps?", "expect_answerable": False},
]


def test_evaluation_and_command_line(spark, index, tmp_path, monkeypatch, capsys):  # noqa: F811
    (tmp_path / "g.json").write_text(json.dumps(GOLDEN))
    golden = archives.load_golden(spark, str(tmp_path / "g.json")).withColumnRenamed("id", "qid")
    found = Engine(spark, index).evaluate(golden)
    summary = found["summary"].first()
    assert (summary.questions, summary.answerable, summary.answer_rate, summary.correct_abstention_rate, summary.mrr) == (2, 1, 1.0, 1.0, 1.0)
    items = {r.qid: r for r in found["items"].collect()}
    assert items["g1"].correct_decision and items["g1"].missing_required == [] and items["g1"].citations_valid and items["g2"].abstained
    assert found["ablation"].count() == 4
    monkeypatch.setenv("CLAUSEFORGE_INDEX_DIR", index)
    assert cli.main(["eval", "--golden", str(tmp_path / "g.json"), "--limit", "1", "--out", str(tmp_path / "r.json")]) == 0
    report = json.loads((tmp_path / "r.json").read_text())
    assert report["summary"]["questions"] == 1 and {"config", "summary", "retrieval_ablation", "items"} == set(report)
    capsys.readouterr()
    assert cli.main(["ask", QUESTION, "-k", "2", "-v", "--json"]) == 0
    out = json.loads(capsys.readouterr().out)
    assert "T4410" in out["answer"] and len(out["sources"]) <= 2 and out["diagnostics"]["expansions"] == ["PCU"]
    assert cli.main(["ask", QUESTION, "--entailment"]) == 2 and cli.main(["ask", "x"]) == 2


def test_service(spark, index):  # noqa: F811
    e = service.engine(spark, Settings(index_dir=index))
    status, health = service.answered(e, "GET", "/api/health", {})
    assert status == 200 and health["chunks"] == 4 and health["embeddings"] == "latent"
    assert service.answered(e, "GET", "/api/glossary/rsp", {}) == (200, {"term": "RSP", "expansions": ["Restart Safety Procedure"]})
    assert service.answered(e, "GET", "/api/glossary/none", {})[0] == 404 and service.answered(e, "GET", "/x", {})[0] == 404
    status, clause = service.answered(e, "GET", "/api/clause/11.222/3.1", {})
    assert status == 200 and clause["heading"] == "Timers" and "T4410" in clause["text"]
    assert service.answered(e, "POST", "/api/ask", {"question": "x"})[0] == 422 and service.answered(e, "POST", "/api/ask", {"question": QUESTION, "top_k": 99})[0] == 422
    status, out = service.answered(e, "POST", "/api/ask", {"question": QUESTION, "top_k": 3, "specs": ["11.222"]})
    assert status == 200 and not out["abstained"] and out["sources"][0]["clause"] == "3.1"
    assert service.answered(e, "POST", "/api/ask", {"question": QUESTION, "specs": ["99.1"]})[1]["abstained"]


def test_fetch_and_build(spark, tmp_path):
    import zipfile

    place = tmp_path / "mirror" / "11_series" / "11.222"
    place.mkdir(parents=True)
    (place / "index.html").write_text('<a href="/x/11222-f10.zip">a</a> <a href="/x/11222-g00.zip">b</a>')
    for code in ("f10", "g00"):
        with zipfile.ZipFile(place / f"11222-{code}.zip", "w") as z:
            z.writestr(f"11222-{code}.docx", MANUAL)
    target, manifest = str(tmp_path / "raw"), str(tmp_path / "manifest")
    assert archives.fetch(spark, str(tmp_path / "mirror"), ["11.222", "22.333"], target, manifest) == 1
    rows = archives.load_manifest(spark, manifest).collect()
    assert [(r.spec_id, r.version, r.filename) for r in rows] == [("11.222", "16.0.0", "11222-g00.zip")]
    assert sorted(p.name for p in (tmp_path / "raw").iterdir() if not p.name.startswith(".")) == ["11222-g00.zip"]
    assert archives.fetch(spark, str(tmp_path / "mirror"), ["22.333"], target, manifest + "2") == 0
    assert archives.fetch(spark, str(tmp_path / "mirror"), ["11.222"], target, manifest + "3", release=15) == 1
    import os

    os.environ["CLAUSEFORGE_INDEX_DIR"] = str(tmp_path / "i")
    try:
        assert cli.main(["build", "--manifest", manifest, "--archives", target]) == 0
        assert store.load(spark, str(tmp_path / "i"))["chunks"].count() == 4
    finally:
        del os.environ["CLAUSEFORGE_INDEX_DIR"]


def test_env_files(tmp_path, monkeypatch):
    (tmp_path / ".env").write_text("# note\nCF_A='one'\nCF_B=two\n")
    monkeypatch.setenv("CF_B", "kept")
    monkeypatch.delenv("CF_A", raising=False)
    load_env(tmp_path / ".env")
    import os

    assert (os.environ.pop("CF_A"), os.environ["CF_B"]) == ("one", "kept")


def test_broadcast_only_if_small(spark):
    small, large = spark.range(3), spark.range(50)
    assert R.sized(small, 10) is not small and R.sized(large, 10) is large
