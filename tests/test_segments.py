"""Running values and neighbours in two levels against a plain pass over each group."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from clauseforge.operators import clauses as C
from clauseforge.operators import segments as S


@pytest.fixture(scope="module")
def made():
    """One group with most rows, a small one, and rows without a group; orders with gaps; nulls among the values."""
    rng = random.Random(6)
    places = sorted(rng.sample(range(1000), 200))
    rows = [("big", p, rng.choice([None, 1, 2, -3]), rng.choice([None, "a", "b"]), f"id{p % 3}") for p in places]
    return rows + [("small", 5, 1, "z", "id0"), (None, 1, 4, "y", "id0"), (None, 300, None, None, "id0"), (None, 301, 2, "x", "id0")]


@pytest.fixture(scope="module")
def rows(spark, made):
    return spark.createDataFrame(made, "g string, p long, v int, s string, id string").repartition(6).cache()


def groups(made):
    out = {}
    for r in sorted(made, key=lambda r: r[1]):
        out.setdefault(r[0], []).append(r)
    return out.values()


@pytest.mark.parametrize("size", [1, 7, 1 << 16])
def test_running_values(rows, made, size):
    got = S.running(rows, ["g"], ["p"], size, total=("sum", F.col("v")), least=("min", F.col("v")), last=("last", F.col("s")))
    assert got.columns == [*rows.columns, "total", "least", "last"]
    want = set()
    for g in groups(made):
        total = least = last = None
        for r in g:
            if r[2] is not None:
                total, least = (total or 0) + r[2], r[2] if least is None else min(least, r[2])
            last = r[3] if r[3] is not None else last
            want.add((r[0], r[1], total, least, last))
    assert {(r.g, r.p, r.total, r.least, r["last"]) for r in got.collect()} == want


@pytest.mark.parametrize("size", [1, 7, 1 << 16])
def test_neighbours(rows, made, size):
    got = S.neighbours(rows, "s", ["g"], ["p"], size, before="b", after="a")
    want = {(r[0], r[1], g[k - 1][3] if k else None, g[k + 1][3] if k + 1 < len(g) else None) for g in groups(made) for k, r in enumerate(g)}
    assert {(r.g, r.p, r.b, r.a) for r in got.collect()} == want


def test_a_word_before_the_number_in_the_order(rows, made):
    """Segments go by the word and then by the number."""
    worded = rows.where("g = 'big'").withColumn("w", F.concat(F.lit("w"), (F.col("p") % 4).cast("string")))
    got = S.running(worded, ["g"], ["w", "p"], 10, n=("sum", F.lit(1))).sort("n").collect()
    order = sorted((f"w{r[1] % 4}", r[1]) for r in made if r[0] == "big")
    assert [(r.w, r.p) for r in got] == order and [r.n for r in got] == list(range(1, len(order) + 1))


def test_segments_share_one_group(rows):
    """No segment of the one long group has over twice the median of rows, so no task of either level has."""
    cut = rows.where("g = 'big'").groupBy(S.segment(rows, ["p"], 50)).count()
    sizes = sorted(r["count"] for r in cut.collect())
    assert len(sizes) == 20 and sizes[-1] <= 2 * sizes[len(sizes) // 2]


@pytest.mark.parametrize("size", [1, 5, 1 << 16])
def test_ancestry_by_a_stack(spark, size):
    """Headings of one long specification and a short one: skipped levels, all nine levels, dropped headings."""
    rng = random.Random(12)
    heads = [(s, n, rng.randint(1, 9) if s == "a" else rng.randint(1, 3), f"{s}{n}", rng.choice(["Scope", "Terms", "Foreword", "contents"])) for s, m in (("a", 160), ("b", 12)) for n in range(1, m + 1)]
    want, stack, spec = {}, [], None
    for s, n, level, number, heading in heads:
        stack = stack[: level - 1] if s == spec else []
        spec = s
        want[s, n] = [x for x in stack]
        if heading.lower() not in C.DROPPED:
            stack = [*stack, (number, heading)]
    table = spark.createDataFrame(heads, "spec_id string, clause_no int, level int, number string, heading string").repartition(4)
    out = C.ancestry(table, size)
    assert out.columns == [*table.columns, "ancestors"]
    assert {(r.spec_id, r.clause_no): [tuple(a) for a in r.ancestors] for r in out.collect()} == want


@pytest.mark.parametrize("size", [3, 1 << 16])
def test_clauses_of_one_specification(spark, size):
    blocks = [("s", p, "p", "Heading 1" if p % 10 == 3 else "", f"Annex {chr(65 + p // 10)} (informative): T" if p % 20 == 3 else f"{p}\tTitle" if p % 10 == 3 else "text", None) for p in range(100)]
    table = spark.createDataFrame(blocks, "spec_id string, pos long, kind string, style string, text string, rows array<array<string>>").repartition(4)
    got = {r.pos: (r.clause_no, r.normative) for r in C.sessionised(table, size).collect()}
    assert got == {p: ((p - 3) // 10 + 1, False) for p in range(3, 100)}
    ids = C.unique_ids(C.sessionised(table, size).withColumn("id", F.lit("x")), order=("pos",), size=size)
    assert {r.pos: r.id for r in ids.collect()} == {p: "x" if p == 3 else f"x~{p - 3}" for p in range(3, 100)}
    linked = C.linked(ids, order=("pos",), size=size)
    assert {r.pos: (r.prev_id, r.next_id) for r in linked.collect()}[4] == ("x", "x~2")
