"""The verifier against a plain one, over whole conversations with values of all kinds put in."""

from __future__ import annotations

import math
import os
import random
import re

import pytest

from clauseforge.functions import text as T
from clauseforge.operators import verify as V
from clauseforge.operators.retrieval import UNKNOWN_IDF

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")
PATTERNS = [re.compile(p.replace("(?Ui)", "(?i)").replace("(?U)", "")) for p in V.HARD]


def flat(t):
    return re.sub(r"\s+", " ", t.lower())


def tokens(t, keep=False):
    out = []
    for x in re.findall(r"[a-z0-9]+(?:[-.][a-z0-9]+)*", t.lower()):
        if keep or x not in T.STOPWORDS:
            out.append(x)
            if re.search("[-.]", x):
                out += [p for p in re.split("[-.]", x) if len(p) > 1 and (keep or p not in T.STOPWORDS)]
    return out


def values(t):
    seen, out = set(), []
    for k, pattern in enumerate(PATTERNS):
        for m in pattern.finditer(t):
            if not (k == 4 and m[0] in V.AMBIENT) and flat(m[0]) not in seen:
                seen.add(flat(m[0]))
                out.append(m[0])
    return out


def verdict(text, cited, offered, idf, least):
    valid = [n for n in cited if n in offered]
    if not valid:
        return False, 0.0, [], "no valid citation"
    body = " ".join(flat(offered[n]) for n in valid)
    words = {x for n in valid for x in tokens(offered[n], True)}

    def there(v):
        key = flat(v)
        return key in body if " " in key else key in words or key.replace(" ", "") in body.replace(" ", "")

    bad = [v for v in values(text) if not there(v)]
    terms = list(dict.fromkeys(tokens(text)))
    weight = lambda x: idf.get(x, UNKNOWN_IDF)
    support = sum(weight(x) for x in terms if x in body) / sum(map(weight, terms)) if terms else 0.0
    if bad:
        return False, support, bad, "not in the cited passage: " + ", ".join(bad[:5])
    if round(support, 9) < least:
        return False, support, bad, f"weak support ({support:.2f})"
    return True, support, bad, "grounded"


def test_against_a_plain_verifier(spark):
    rng = random.Random(6)
    texts = [r.text for r in spark.read.parquet(f"{DATA}/conversations.parquet").sort("conv_id", "turn").collect() if r.text]
    odd = ["T3346", "TS 24.501", "ts 23.122", "0xAF", "12.5", "12.5a", "7", "MM IDLE-STATE", "ABC/DE", "UE", "5G-AKA", "x7", "3.14.", "(42)", "É9"]
    rows, sources = [], {}
    for i in range(400):
        offered = {n: f"{rng.choice(texts)[:300]} {rng.choice(odd)} {rng.choice(odd)}." for n in (1, 2)}
        part = rng.choice([offered[1], offered[2], rng.choice(texts)])[: rng.randint(20, 200)]
        rows.append((i, 0, f"{part} {rng.choice(odd)} and {rng.choice(odd)}", rng.choice([[1], [2], [1, 2], [3], [], [2, 9]])))
        sources[i] = offered
    idf = {x: 1 + math.log(1 + k % 13) for k, x in enumerate({x for t in texts for x in tokens(t)})}
    parsed = spark.createDataFrame(rows, "qid long, claim_no long, text string, citations array<int>")
    given = spark.createDataFrame([(i, n, t) for i, by in sources.items() for n, t in by.items()], "qid long, n int, text string")
    got = {r.qid: r for r in V.verified(parsed, given, spark.createDataFrame(list(idf.items()), "term string, idf double")).collect()}
    reasons = set()
    for i, _, text, cited in rows:
        supported, support, bad, reason = verdict(text, cited, sources[i], idf, V.MIN_CLAIM_SUPPORT)
        r = got[i]
        assert (r.supported, round(r.support, 6), r.ungrounded, r.reason) == (supported, round(support, 6), bad, reason), (text, sources[i], cited)
        assert r.citations == [n for n in cited if n in sources[i]]
        reasons.add(reason.split(" ")[0])
    assert reasons == {"no", "not", "weak", "grounded"}


def test_claims_keep_their_first_and_last_characters(spark):
    """Lines that begin or end with the digits of their own number; spaces around a line go."""
    lines = ["0 valves are shut 0", "  1 pump runs for 11 ", "2.5 bar [S1]", "", "33 pumps [S2]", "- 4 of 4"] + ["a line"] * 4 + ["10.1.0.1 answers"]
    got = V.claims(spark.createDataFrame([(1, "\n".join(lines))], "qid long, answer string")).sort("claim_no").collect()
    want = ["0 valves are shut 0", "1 pump runs for 11", "2.5 bar", "33 pumps", "4 of 4"] + ["a line"] * 4 + ["10.1.0.1 answers"]
    assert [(r.claim_no, r.text) for r in got] == list(enumerate(want))


def test_values_are_found_once_a_row(spark):
    from clauseforge.plans.answering import v2_hard_tokens

    text = "TS 24.501, ts  24.501 and T3402, t3402; 0xAB MM IDLE UE PDU-1 3.5, 3.5."
    rows = spark.createDataFrame([(text,), (None,), ("",)], "t string")
    found = rows.select(V.hard_tokens(rows["t"]).alias("v"))
    assert [r.v for r in found.collect()] == [values(text), None, []]
    # A pattern stands in the plan once: beneath a lambda of the values it would run again for each of them.
    for plan in (found, v2_hard_tokens(spark, DATA)):
        assert plan._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == len(V.HARD)


def test_texts_are_cut_before_they_are_rewritten(spark, tmp_path):
    from clauseforge.plans.answering import v2_hard_tokens

    texts = ["Ab\U0001f600 ü" * 40, "x" * 88 + "\U0001f600AB CD", "T3402\n" + "é" * 200, "", None]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    d.write.parquet(f"{tmp_path}/documents.parquet")
    for r in v2_hard_tokens(spark, str(tmp_path)).collect():
        t = texts[r.doc_id]
        if t is None:
            assert r.hard is None
            continue
        n = r.doc_id
        made = f"See ts 24.{100 + n % 7}, T3{n % 300}x, 0xA{n} and MM IDLE-{n} or UE, ABC/D{n} NAS. " + re.sub("[^ -~]", "x", t)[:90].upper()
        assert r.hard == "|".join(v for v in values(made) if re.search("[A-Za-z]", v))
