"""Word files to an index to answers, on a small specification of our own."""

from __future__ import annotations

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from clauseforge import cli
from clauseforge.config import Settings, number
from clauseforge.engine import Engine, build_index
from clauseforge.operators import answers as A
from clauseforge.operators import clauses as C
from clauseforge.operators import evaluate as E
from clauseforge.operators import plugins as P
from clauseforge.operators import retrieval as R
from clauseforge.operators import verify as V
from clauseforge.sources import archives, docx, store

W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"


def paragraph(text, style=None):
    runs = "<w:tab/>".join(f"<w:t>{t}</w:t>" for t in text.split("\t"))
    head = f'<w:pPr><w:pStyle w:val="{style}"/></w:pPr>' if style else ""
    return f"<w:p>{head}<w:r>{runs}</w:r></w:p>"


def word(*body):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{W}"><w:body>{"".join(body)}</w:body></w:document>')
    return out.getvalue()


TABLE = '<w:tbl><w:tr><w:tc><w:tcPr><w:gridSpan w:val="2"/></w:tcPr><w:p><w:r><w:t>Valve</w:t></w:r></w:p></w:tc></w:tr><w:tr><w:tc><w:p><w:r><w:t>a|b</w:t></w:r></w:p></w:tc><w:tc><w:p/></w:tc></w:tr></w:tbl>'
MANUAL = word(
    paragraph("lost before the first heading"),
    paragraph("1\tScope", "Heading1"),
    paragraph("This manual describes pumps of series 77 and how operators restart them after a fault."),
    paragraph("2\tAbbreviations", "Heading1"),
    paragraph("PCU\tPump Control Unit"),
    paragraph("RSP\tRestart Safety Procedure;"),
    paragraph("not an entry"),
    paragraph("3\tRestart", "Heading1"),
    paragraph("3.1\tTimers", "Heading2"),
    paragraph("The Pump Control Unit shall start timer T4410 when the pressure falls below 12 bar. "),
    paragraph("After expiry of timer T4410 the operator shall run the restart safety procedure within 30 seconds."),
    '<w:p><w:r><w:t>Keep </w:t></w:r><w:del><w:r><w:delText>GONE</w:delText><w:t>GONE</w:t></w:r></w:del><w:r><w:t>this\xa0line</w:t><w:noBreakHyphen/><w:t>x</w:t></w:r></w:p>',
    TABLE,
    paragraph("Change history", "Heading1"),
    paragraph("version 9 added"),
    paragraph("Annex A (informative):\tColours", "Heading1"),
    paragraph("Red pumps are hot and blue pumps are cold in every plant that follows this manual."),
    paragraph("4\tEmpty", "Heading1"),
)


@pytest.fixture(scope="module")
def parts(spark):
    return spark.createDataFrame([("11.222", 1, "m_1.docx", MANUAL), ("11.222", 2, "old.doc", b"x")], "spec_id string, part int, name string, content binary")


@pytest.fixture(scope="module")
def index(spark, parts, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index") / "i")
    build_index(parts, spark.createDataFrame([("11.222", "15.1.0", 15)], "spec_id string, version string, release int"), path)
    return path


def ask(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "qid long, question string")


def test_blocks(parts):
    rows = docx.read_blocks(parts).sort("pos").collect()
    assert rows[1].style == "Heading1" and rows[1].text == "1\tScope"
    assert any(r.text == "Keep this line-x" for r in rows) and not any("GONE" in r.text for r in rows)
    assert [r.rows for r in rows if r.kind == "t"] == [[["Valve", ""], ["a|b", ""]]]
    empty = io.BytesIO()
    zipfile.ZipFile(empty, "w").close()
    assert docx.blocks_of(empty.getvalue()) == []


def test_clauses(parts):
    rows = {r.number: r for r in C.clauses(docx.read_blocks(parts)).collect()}
    assert set(rows) == {"1", "2", "3.1", "A"}
    assert [(a.number, a.heading) for a in rows["3.1"].ancestors] == [("3", "Restart")]
    assert rows["3.1"].normative and not rows["A"].normative
    assert rows["3.1"].tables == ["| Valve |  |\n|---|---|\n| a\\|b |  |"]


def test_lexicon(spark, parts):
    forward, reverse = C.lexicon(C.entries(C.clauses(docx.read_blocks(parts))))
    assert {(r.acronym, r.expansion) for r in forward.collect()} == {("PCU", "Pump Control Unit"), ("RSP", "Restart Safety Procedure")}
    got = C.expand(ask(spark, "when does the PCU run a restart safety procedure"), forward, reverse).sort("ord").collect()
    assert [r.expansion for r in got] == ["Pump Control Unit", "RSP"]


def test_packing_of_chunks():
    long = " ".join(f"Word{i} and so on." for i in range(300))
    pieces = C.packed([long, "short end"], 120, 160, 30)
    assert len(pieces) > 5 and all(C._size(p) <= 160 for p in pieces)
    table = "| h |\n|---|\n" + "\n".join(f"| row {i} |" for i in range(200))
    bands = C.cut_block(table, 50)
    assert len(bands) > 3 and all(b.startswith("| h |\n|---|\n") for b in bands)
    assert sum(b.count("row") for b in bands) == 200
    units = [f"unit {i} " + "w " * 20 for i in range(10)]
    overlapped = C.packed(units, 60, 160, 25)
    assert all(a.split("\n\n")[-1] == b.split("\n\n")[0] for a, b in zip(overlapped, overlapped[1:]))
    assert C.packed([], 10, 10, 1) == []


def test_index_round_trip(spark, index):
    tables = store.load(spark, index)
    assert {r.clause for r in tables["chunks"].collect()} == {"1", "2", "3.1", "A"}
    assert store.specs(tables["chunks"]).first().asDict() == {"spec_id": "11.222", "version": "15.1.0", "release": 15, "chunks": 4}
    assert store.clause_text(tables["chunks"], "11.222", "9").count() == 0
    assert [r.expansion for r in store.lookup(tables["lexicon"], "pcu").collect()] == ["Pump Control Unit"]
    with pytest.raises(FileNotFoundError):
        store.load(spark, index + "-none")
    with pytest.raises(ValueError):
        store.build(tables["chunks"].limit(0), index + "-empty")


def test_answers(spark, index):
    engine = Engine(spark, index, Settings())
    out = engine.ask(ask(spark, "When does the pump control unit start timer T4410?", "What does TS 99.999 say about pumps?", "zebra quokka"))
    got = {r.qid: r for r in out["answers"].collect()}
    assert not got[0].abstained and "T4410" in got[0].answer and "[S1]" in got[0].answer and got[0].groundedness == 1.0
    assert got[1].abstained and "99.999" in got[1].reason and got[1].answer == A.REFUSAL
    assert got[2].abstained and got[2].reason == A.NO_HITS
    hits = out["hits"].where("qid = 0").sort("rank").collect()
    assert hits[0].clause == "3.1"


def test_named_clause_is_pinned(spark, index):
    got = Engine(spark, index).retrieve(ask(spark, "pumps in clause A of the manual")).sort("rank").collect()
    assert got[0].clause == "A" and got[0].pinned


class Inventing(P.LanguageModel):
    name = "inventing"

    def complete(self, system, prompt):
        if "never" in prompt:
            raise RuntimeError("down")
        return "The unit starts timer T4410 when the pressure falls below 12 bar. [S1]\nThe unit waits 99 seconds for timer T5555. [S1]\nNo source."


def test_invented_values_are_dropped(spark, index):
    out = Engine(spark, index, llm=Inventing()).ask(ask(spark, "When does the pump control unit start timer T4410?"))
    row = out["answers"].first()
    assert "12 bar" in row.answer and "T5555" not in row.answer and (row.kept, row.claims) == (1, 3)
    reasons = {r.claim_no: r.reason for r in out["claims"].collect()}
    assert reasons[0] == "grounded" and "T5555" in reasons[1] and reasons[2] == "no valid citation"


def test_hard_tokens(spark):
    text = "Timer T3346x runs 12.5.1 s per TS 24.501, code 0xAF, MM IDLE-STATE and UE sends ABC/DE; é1 abc3 ABC/DE"
    d = spark.createDataFrame([(text,)], "t string").select(V.hard_tokens(F.col("t")).alias("h")).first().h
    assert d[:3] == ["TS 24.501", "T3346x", "0xAF"] and "ABC/DE" in d and "12.5.1" in d and "UE" not in d and d.count("ABC/DE") == 1
    assert not any(x in ("1", "3") for x in d)


def test_grounding_modes(spark):
    claims = spark.createDataFrame([(1, 0, "wait 5 minutes for pumps", [1])], "qid long, claim_no long, text string, citations array<int>")
    sources = spark.createDataFrame([(1, 1, "Wait 15 minutes for pumps.")], "qid long, n int, text string")
    idf = spark.createDataFrame([], "term string, idf double")
    assert V.verified(claims, sources, idf).first().supported
    assert not V.verified(claims, sources, idf, strict=True).first().supported


def test_entailment_overrides(spark):
    verdicts = spark.createDataFrame([(1, 0, True, "grounded"), (1, 3, True, "grounded")], "qid long, claim_no long, supported boolean, reason string")
    replies = spark.createDataFrame([(1, "1: supported\nnoise\n 2) NOT_SUPPORTED")], "qid long, reply string")
    got = {r.claim_no: (r.supported, r.entailment) for r in V.entailment(verdicts, replies).collect()}
    assert got == {0: (True, "SUPPORTED"), 3: (False, "NOT_SUPPORTED")}


def test_gate_rules(spark):
    rows = [(0, 0.0, 0.0, 0.0, 0), (1, 0.1, 0.5, 0.5, 3), (2, 0.9, 0.5, 0.01, 3), (3, 0.25, 0.1, 0.5, 3), (4, 0.33, 0.1, 0.5, 3), (5, 0.9, 0.9, 0.9, 3), (6, 0.9, 0.9, 0.9, 3)]
    sig = spark.createDataFrame(rows, "qid long, top double, support double, overlap double, hits long")
    unknown = spark.createDataFrame([(6, 0, "t9999")], "qid long, ord int, term string")
    got = {r.qid: r for r in A.gate(sig, unknown).collect()}
    assert [got[i].answerable for i in range(7)] == [False, False, False, False, True, True, False]
    assert "t9999" in got[6].reason and got[5].confidence == 0.9


def test_budget_keeps_a_prefix(spark):
    hits = spark.createDataFrame([(1, 1, "x" * 50), (1, 2, "x" * 60), (1, 3, "x"), (2, 1, "x" * 500)], "qid long, rank long, block string")
    got = A.within_budget(hits, F.col("block"), 100).select("qid", "n").collect()
    assert {(r.qid, r.n) for r in got} == {(1, 1), (2, 1)}


def test_dense_search_keeps_negatives(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [-1.0, 0.0]), (3, [0.0, 1.0])], "pos long, vector array<double>")
    q = spark.createDataFrame([(7, [1.0, 0.0])], "qid long, vector array<double>")
    assert [(r.pos, r.score) for r in R.dense_search(v, q, 5).sort("rank").collect()] == [(1, 1.0), (3, 0.0), (2, -1.0)]


def test_item_checks(spark):
    answers = spark.createDataFrame([("a", "Timer T1 runs", False, 2, [1, 3]), ("b", "", True, 0, [])], "qid string, answer string, abstained boolean, offered int, cited array<int>")
    golden = spark.createDataFrame([("a", True, ["t1", "T2"], ["runs"]), ("b", False, ["x"], [])], "qid string, expect_answerable boolean, must_include array<string>, must_not_include array<string>")
    got = {r.qid: r for r in E.item_checks(answers, golden).collect()}
    assert (got["a"].missing_required, got["a"].forbidden_present, got["a"].citations_valid, got["a"].correct_decision) == (["T2"], ["runs"], False, True)
    assert got["b"].missing_required == [] and got["b"].correct_decision


def test_archives(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "11222-f10.zip", "w") as z:
        z.writestr("d/11222-f10_2_b.docx", MANUAL)
        z.writestr("11222-f10_1_a.docx", MANUAL)
        z.writestr("readme.txt", "no")
    got = archives.word_parts(spark, str(tmp_path)).sort("part").collect()
    assert [r.name for r in got] == ["11222-f10_1_a.docx", "11222-f10_2_b.docx"]
    rows = spark.createDataFrame([("s", 15), ("s", 16)], "spec_id string, release int")
    archives.require(rows, 15)
    with pytest.raises(LookupError, match="17"):
        archives.require(rows, 17)


def test_golden_sets(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"_note": "x", "questions": [{"id": "q1", "question": "Why?", "expect_clauses": ["5.1"]}]}')
    (tmp_path / "b.json").write_text('[{"id": "q2", "question": "How?", "expect_answerable": false}]')
    a, b = (archives.load_golden(spark, str(tmp_path / f"{n}.json")).collect() for n in "ab")
    assert (a[0].id, a[0].expect_clauses, a[0].expect_answerable) == ("q1", ["5.1"], True)
    assert (b[0].id, b[0].expect_answerable, b[0].must_include) == ("q2", False, [])


def test_registries_and_settings(monkeypatch):
    assert P.resolve(P.RERANKERS, "lexical") is None
    with pytest.raises(ValueError):
        P.resolve(P.RERANKERS, "other")
    monkeypatch.setenv("N", "x")
    assert number("N", 3, int) == 3 and number("UNSET_N", 1.5) == 1.5
    monkeypatch.setenv("CLAUSEFORGE_K", "9")
    assert Settings.from_env().retrieval.final_k == 9


def test_plugged_models(spark):
    class Length(P.ModelReranker):
        pass

    pairs = spark.createDataFrame([(1, 1, "q", "abc")], "qid long, pos long, question string, passage string")
    assert abs(Length("n", lambda: lambda ps: [0.0 for _ in ps]).score(pairs).first().score - 0.5) < 1e-9
    e = P.ModelEmbeddings("e5-small", lambda: lambda texts: [[float(len(t)), 0.0] for t in texts])
    assert e.questions(spark.createDataFrame([(1, "abc")], "qid long, question string")).first().vector == [1.0, 0.0]


def test_command_line(index, monkeypatch, capsys):
    monkeypatch.setenv("CLAUSEFORGE_INDEX_DIR", index)
    assert cli.main(["glossary", "rsp"]) == 0 and "Restart Safety Procedure" in capsys.readouterr().out
    assert cli.main(["glossary", "nope"]) == 1
    monkeypatch.setenv("CLAUSEFORGE_INDEX_DIR", index + "-none")
    assert cli.main(["glossary"]) == 2


def test_question_stream(spark, tmp_path):
    from clauseforge.streaming.questions import answered

    source = tmp_path / "in"
    ask(spark, "one", "two").write.parquet(str(source))
    stream = spark.readStream.schema("qid long, question string").parquet(str(source))
    answered(stream, lambda b: b.withColumn("answer", F.upper("question")), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert {r.answer for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {"ONE", "TWO"}
