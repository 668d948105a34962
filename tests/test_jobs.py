"""The jobs over growing input, cut off and run again, against indexes and reports made at once."""

from __future__ import annotations

import json
import os
import subprocess
import sys
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from clauseforge.operators import index as I
from jobs import answer_report, index_feed, settings

SCHEMA = "doc_id long, text string, lang string, source string, batch string, bucket double"
FIRST = [
    (1, "The pump control unit starts timer T4410 when the valve opens.", "en", "a"),
    (2, "Die Pumpe startet nicht, bevor das Ventil geöffnet ist.", "de", "a"),
    (3, None, "en", "b"),
    (4, "", None, None),
    (5, "pump pump pump valve", "en", "b"),
    (None, "no id, never indexed xyzzy", "en", "b"),
    (5, "pump pump pump valve", "en", "b"),
]
SECOND = [
    (2, "Die Pumpe startet sofort.", "de", "a"),
    (5, "pump pump pump valve", "en", "b"),
    (6, "Colours of valves are listed in T4410-2.", "en", "c"),
    (7, "same text", "en", "c"),
    (8, "same text", "en", "c"),
]
THIRD = [(2, "Die Pumpe startet nicht, bevor das Ventil geöffnet ist.", "de", "a"), (6, None, "en", "c")]


def add(spark, path, rows):
    """One more file with these rows, and columns that look like the job's own."""
    spark.createDataFrame([(*r, "x", 1.5) for r in rows], SCHEMA).coalesce(1).write.mode("append").parquet(path)


@pytest.fixture
def config(tmp_path):
    at = lambda name: str(tmp_path / name)
    return index_feed.Config(at("documents"), at("index"), at("checkpoint"), buckets=4, spread=2)


def last(*files):
    """Documents as they stand after these files."""
    return {r[0]: r for rows in files for r in rows if r[0] is not None}


def same_as_at_once(spark, config, rows):
    """Every table of the index is that of the documents indexed at once."""
    held = index_feed.tables(spark, config.out)
    made = spark.createDataFrame([(*r, "x", 1.5) for r in rows.values()], SCHEMA)
    want = I.tables(index_feed.indexed(index_feed.incoming(made)))
    for name, columns in (("postings", ("pos", "dl", "term", "tf")), ("terms", ("term", "df")), ("stats", ("n", "avgdl"))):
        got = sorted(tuple(r) for r in held[name].select(*columns).collect())
        assert got == sorted(tuple(r) for r in want[name].select(*columns).collect()), name
    weights = {(r.pos, r.term): r.w for r in want["weights"].collect()}
    assert {(r.pos, r.term): r.w for r in held["weights"].collect()} == pytest.approx(weights)
    assert {r.pos for r in held["chunks"].collect()} == set(rows)


def files(path):
    return sorted(os.path.join(d, f) for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet"))


def test_feed_takes_only_what_is_new(spark, config):
    add(spark, config.documents, FIRST)
    assert index_feed.run(spark, config) == {"batches": 1, "rows": 7, "taken": 5}
    same_as_at_once(spark, config, last(FIRST))
    held = files(config.out)
    assert index_feed.run(spark, config) == {"batches": 0, "rows": 0, "taken": 0}
    assert files(config.out) == held
    add(spark, config.documents, SECOND)
    assert index_feed.run(spark, config)["rows"] == len(SECOND)
    same_as_at_once(spark, config, last(FIRST, SECOND))
    assert held == [f for f in files(config.out) if "batch=0" in f]
    new = index_feed.read(spark, config.out, "documents", index_feed.DOCUMENTS).where("batch = 1")
    assert sorted(r.pos for r in new.collect()) == [2, 6, 7, 8]
    add(spark, config.documents, THIRD)
    index_feed.run(spark, config)
    same_as_at_once(spark, config, last(FIRST, SECOND, THIRD))
    assert spark.conf.get("spark.sql.sources.partitionOverwriteMode").lower() == "static"


@pytest.mark.parametrize("table", ["documents", "postings", "batches"])
def test_a_batch_cut_off_is_run_again(spark, config, monkeypatch, table):
    """Lost right after the table was written: until ``batches`` is, what is read is the batch before."""
    add(spark, config.documents, FIRST)
    index_feed.run(spark, config)
    add(spark, config.documents, SECOND)
    real = index_feed.I.postings if table == "documents" else index_feed.stored

    def lost(*args, **options):
        if os.path.isdir(f"{config.out}/{table}/batch=1"):
            raise OSError("lost")
        return real(*args, **options)

    with monkeypatch.context() as m:
        m.setattr(*((index_feed.I, "postings") if table == "documents" else (index_feed, "stored")), lost)
        with pytest.raises(Exception, match="lost"):
            index_feed.run(spark, config)
    same_as_at_once(spark, config, last(FIRST, SECOND) if table == "batches" else last(FIRST))
    index_feed.run(spark, config)
    same_as_at_once(spark, config, last(FIRST, SECOND))


def test_feed_by_files_and_from_one_file(spark, config):
    for rows in (FIRST, SECOND[2:]):
        add(spark, config.documents, rows)
    one = replace(config, files_per_batch=1)
    assert index_feed.run(spark, one) == {"batches": 2, "rows": len(FIRST) + len(SECOND) - 2, "taken": 8}
    same_as_at_once(spark, config, last(FIRST, SECOND[2:]))
    single = replace(config, documents=files(config.documents)[0], out=f"{config.out}-2", checkpoint=f"{config.checkpoint}-2")
    assert index_feed.run(spark, single)["batches"] == 1


def test_feed_refuses_another_checkpoint(spark, config):
    for rows in (FIRST, SECOND):
        add(spark, config.documents, rows)
        index_feed.run(spark, config)
    other = replace(config, checkpoint=f"{config.checkpoint}-2")
    with pytest.raises(Exception, match="another checkpoint"):
        index_feed.run(spark, other)
    same_as_at_once(spark, config, last(FIRST, SECOND))


def test_feed_of_empty_files(spark, config):
    add(spark, config.documents, [])
    index_feed.run(spark, config)
    held = index_feed.tables(spark, config.out)
    assert held["postings"].count() == held["terms"].count() == held["chunks"].count() == 0
    assert held["stats"].first().n == 0
    add(spark, config.documents, FIRST)
    index_feed.run(spark, config)
    same_as_at_once(spark, config, last(FIRST))


ASKED = [(1, "When does the pump control unit start timer T4410?"), (2, "zzzz qqqq"), (3, None), (4, "Ventil geöffnet"), (4, "Pumpe"), (None, "nobody asks")]


@pytest.fixture
def asked(spark, config, tmp_path):
    spark.createDataFrame([(*q, "x") for q in ASKED], "item_id long, text string, pos string").write.parquet(str(tmp_path / "questions"))
    return str(tmp_path / "questions")


def test_report_from_tables_and_from_the_index(spark, config, asked, tmp_path):
    add(spark, config.documents, FIRST)
    plain = answer_report.Config(config.documents, asked, str(tmp_path / "report"))
    by_rule = answer_report.run(spark, plain)
    rows = {tuple(r) for r in answer_report.written(spark, plain.out).collect()}
    assert sum(by_rule.values()) == 4 and by_rule["retrieval"] == 2
    first = [r for r in answer_report.written(spark, plain.out).where("qid = 1").sort("rank").collect()]
    assert first[0].pos == 1 and first[0].answerable and first[0].citation == "a v1, clause en"
    assert [(r.rank, r.pos, r.rule) for r in answer_report.written(spark, plain.out).where("qid = 2").collect()] == [(None, None, "retrieval")]
    assert {r.qid for r in answer_report.written(spark, plain.out).where("qid = 4").collect()} == {4}
    assert sorted(d for d in os.listdir(plain.out) if "=" in d) == ["answerable=false", "answerable=true"]
    answer_report.run(spark, plain)
    assert {tuple(r) for r in answer_report.written(spark, plain.out).collect()} == rows
    index_feed.run(spark, config)
    fed = answer_report.Config(config.documents, asked, str(tmp_path / "report-2"), config.out)
    answer_report.run(spark, fed)
    assert {tuple(r) for r in answer_report.written(spark, fed.out).collect()} == rows


def test_settings(tmp_path):
    path = tmp_path / "c.json"
    path.write_text(json.dumps({"documents": "d", "out": "o", "buckets": 8}))
    c = settings.command(index_feed.Config, [str(path), "--out", "p", "--files-per-batch", "3"], "doc")
    assert (c.documents, c.out, c.buckets, c.files_per_batch) == ("d", "p", 8, 3)
    path.write_text(json.dumps({"document": "d"}))
    with pytest.raises(ValueError, match="unknown settings document"):
        settings.command(index_feed.Config, [str(path)], "doc")
    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for kind, name in ((index_feed.Config, "index_feed"), (answer_report.Config, "answer_report")):
        assert settings.from_file(kind, f"{here}/jobs/{name}.json", {}).documents


def test_command_line(spark, config, tmp_path):
    add(spark, config.documents, FIRST)
    path = tmp_path / "c.json"
    path.write_text(json.dumps({"documents": config.documents, "out": config.out, "checkpoint": config.checkpoint, "buckets": 2, "spread": 1}))
    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    done = subprocess.run([sys.executable, "-m", "jobs.index_feed", str(path)], cwd=here, capture_output=True, text=True, timeout=300, check=True)
    assert "batch 0: read 7 rows" in done.stderr and "wrote 5 documents" in done.stderr
    same_as_at_once(spark, config, last(FIRST))
