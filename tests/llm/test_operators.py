"""Every operator against a plain version, and over odd rows, repeated rows, empty tables and clashing names."""

from __future__ import annotations

import hashlib
import random
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from clauseforge.llm import boosting, bpe, decontaminate, html_text, langid, packing, pii, quality, secrets, simhash, spans, substrings, suffix
from clauseforge.llm.queries import vocabulary
from tests.llm import plain

#: Column names that operators use inside, or that look like results.
CLASHING = ["id", "fp", "k", "blob", "_blob", "_salt", "_findings", "_words", "_lines", "_good", "_gone", "_base", "_spans", "text_", "n_words", "component", "a b", "x.y"]
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), *(T.StructField(c, T.StringType()) for c in CLASHING)])


def texts():
    rng = random.Random(5)
    syllables = ["ba", "ke", "lo", "mi", "nu", "ra", "se", "ti", "vo", "st", "an", "er", "ção", "ü"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    sentence = lambda n: " ".join(word() for _ in range(n)).capitalize() + "."
    base = [" ".join(sentence(rng.randint(4, 14)) for _ in range(rng.randint(1, 8))) for _ in range(24)]
    out = [None, "", " ", "\n\n", "a", "É", "½ ² 3", "\x85 x", "\x00\x01 \x1c", "🙂 🙂🙂 🙂", "AΣ İstanbul ﬁ ŉ", "é combining"]
    out += base + base[:6] + base[:2]
    out += [b + " " + sentence(3) for b in base[:8]] + [sentence(3) + "\n" + b for b in base[8:14]]
    out += ["Mail a.b@c.de or x@y, +1 (555) 555-1234, 4111 1111 1111 1111, 192.168.001.1 and 1.2.3.400.", "1" * 40, "+" * 5 + "12345678", "a@b.c_d@e.f@g.h", "4111111111111111" * 3]
    out += ['password = "abcdef123" TOKEN:xy api_key=\'0123456789abcdef01234567\' AKIA' + "A" * 16, "deadbeef" * 6 + " apikey==abcdefg", "secret" + " " * 500 + "= hunter22x"]
    out += ["The the the the the the the the the the the the.", "!!! SHOUT!! ALL!! DAY!! LONG!! AND!! MORE!! OF!! IT!! NOW!!", "a | b | c | d | e | f | g | h | i | j | k"]
    out += ["x" * 30_000, "ab " * 9_000, ". " * 4_000, "1.2." * 6_000, "a@" * 6_000, " ".join(base) * 3, "<|endoftext|> and <|startoftext|>x", "aaaa" * 50, "don't I'LL we've 's 't"]
    return out


@pytest.fixture(scope="module")
def rows():
    return [(i, t) for i, t in enumerate(texts())]


@pytest.fixture(scope="module")
def docs(spark, rows):
    lang = ["en", "de", None]
    full = [(i, t, lang[i % 3], *(["x"] * len(CLASHING))) for i, t in rows]
    return spark.createDataFrame([*full, full[3], full[14], (None, full[14][1], None, *([None] * len(CLASHING)))], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df, key="doc_id"):
    """id -> row; rows that repeat an id must be alike, as their inputs are."""
    out = {}
    for r in df.collect():
        if r[key] is not None:
            assert out.setdefault(r[key], r) == r
    return out


def hexed(s):
    return hashlib.sha256(s.encode()).hexdigest()


def test_pii(docs, empty, rows):
    got = by_id(pii.digest(docs))
    for i, t in rows:
        want = plain.spans(t, plain.PII)
        assert got[i].base_sha256 == hexed(",".join(f"{n}:{a}:{b}" for _, n, a, b in want)), (i, t, got[i])
        assert {f"{n}:{a}:{b}" for _, n, a, b in want} <= set(got[i].spans.split(","))
    assert pii.digest(empty).count() == 0 and pii.digest(docs).count() == docs.count()


def test_pii_adds_spelled_out_spans(spark):
    rows = [(0, "call +1 (555) 555-1000 or mail u0@example.com about version 3.2.1"), (1, "call 1 (555) 555-7777 today"), (2, "mail joe [at] example [dot] com"), (3, "on 2024-01-15 at 12:30:45, order 1234567890123")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = by_id(pii.digest(docs))
    assert [got[i].spans for i in range(4)] == ["email:31:45,phone:5:22", "phone:5:21", "email:5:31", ""]
    clean = {r.doc_id: r.text for r in pii.redact(docs).collect()}
    assert clean[0] == "call [phone] or mail [email] about version 3.2.1" and clean[1] == "call [phone] today"


def test_pii_adds_by_kind_with_precision_and_recall(spark):
    """Held-out examples, drawn anew: spans that no base rule knows are added, look-alikes are not."""
    rows = [(k, i, good, text) for k, kind in enumerate(pii.KINDS) for i, (text, good) in enumerate(pii.examples(kind, 300, seed=23))]
    docs = spark.createDataFrame([(k * 1000 + i, t) for k, i, _, t in rows], "doc_id long, text string")
    got = by_id(pii.digest(docs))
    for k, kind in enumerate(pii.KINDS):
        added = [(good, kind + ":" in got[k * 1000 + i].spans and not got[k * 1000 + i][f"n_{kind}"]) for q, i, good, _ in rows if q == k]
        right = sum(good and hit for good, hit in added)
        assert right / sum(hit for _, hit in added) > 0.95 and right / sum(good for good, _ in added) > 0.9, kind


def test_spans_of_many_hits(spark):
    """200,000 addresses in one text: places stay right, and the time grows about as the hits do."""
    docs = lambda n: spark.createDataFrame([(1, " é ".join(f"10.0.{i % 250}.{i % 7}" for i in range(n)))], "doc_id long, text string")
    pii.digest(docs(10)).collect()
    began = time.time()
    few = pii.digest(docs(20_000)).collect()[0]
    middle = time.time()
    many = pii.digest(docs(200_000)).collect()[0]
    assert (few.n_ip, many.n_ip) == (20_000, 200_000) and many.spans.startswith(few.spans)
    assert time.time() - middle < 30 * (middle - began) + 10
    text = " ".join(f"token={i:08d}" for i in range(20_000))
    out = secrets.redact(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()[0]
    assert out.text == " ".join(["[assign]"] * 20_000)


@pytest.mark.parametrize("seed", range(3))
def test_span_functions(spark, seed):
    rng = random.Random(seed)
    cases = []
    for i in range(40):
        text = "".join(rng.choice("aé🙂 b") for _ in range(rng.choice([0, 1, 30, 5000])))
        cut = lambda: sorted((a, min(len(text), a + rng.randint(1, 40))) for a in rng.sample(range(len(text)), min(len(text), rng.choice([0, 1, 2, 9]))))
        cases.append((i, text, cut(), cut()))
    df = spark.createDataFrame(cases, "i int, t string, a array<struct<s:int,e:int>>, b array<struct<s:int,e:int>>")
    got = {r.i: r for r in df.select("i", spans.apart(F.col("a"), F.col("b")).alias("free"), spans.redacted(F.col("t"), F.col("a"), lambda x: F.lit("#")).alias("out")).collect()}
    for i, text, a, b in cases:
        assert [tuple(x) for x in got[i].free] == [x for x in a if not any(y[0] < x[1] and y[1] > x[0] for y in b)]
        out, at = "", 0
        for s, e in a:
            if s >= at:
                out += text[at:s] + "#"
            at = max(at, e)
        assert got[i].out == out + text[at:]


def test_boosting_learns_an_and():
    counts = {b: ((90.0, 10.0) if b & 3 == 3 else (5.0, 95.0)) for b in range(16)}
    model = boosting.fit(counts, 4, rounds=30)
    assert model.probability(3) > 0.8 > 0.2 > model.probability(1)
    assert boosting.threshold(model, counts, 0.85) <= model.probability(3)
    assert boosting.threshold(model, {0: (0.0, 5.0)}, 0.5) > 1


def test_quality(docs, empty, rows):
    got = by_id(quality.rules(docs))
    for i, t in rows:
        base, failed, kept, text = plain.quality(t)
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == base, (i, t)
        assert (r.base_failed, r.kept, r.clean_text) == (failed, kept, text), (i, t)
    kept = quality.clean(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id: r.text for r in kept.collect() if r.doc_id is not None} == {i: plain.quality(t)[3] for i, t in rows if plain.quality(t)[2]}
    assert quality.rules(empty).count() == 0 and quality.clean(empty).count() == 0


def check_pieces(pieces, rows, extra=0):
    t = Tokenizer.from_file(vocabulary())
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
        by_sequence.setdefault(p.sequence_id, []).append(p)
    for i, text in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids + [2]
        want = np.array(ids, "<u4").tobytes()
        mine = sorted(by_doc[i], key=lambda p: (p.start, p.sequence_id))
        assert all(p.doc_tokens == len(ids) and bytes(p.ids) == want[4 * p.start : 4 * (p.start + p.length)] for p in mine)
        assert sum(p.length for p in mine) % len(ids) == 0
    for s in by_sequence.values():
        s.sort(key=lambda p: p.offset)
        assert [p.offset for p in s] == np.cumsum([0, *(p.length for p in s)])[:-1].tolist()
        assert sum(p.length for p in s) == s[0].window and s[0].window & (s[0].window - 1) == 0 and s[0].window <= 4096


def test_packing(docs, empty, rows):
    pieces = packing.pack_documents(docs, vocabulary()).collect()
    check_pieces(pieces, rows)
    steps = {}
    for p in {(p.sequence_id, p.window, p.step_group) for p in pieces}:
        steps.setdefault(p[2], []).append(p[1])
    assert all(sum(w) <= packing.STEP_TOKENS for w in steps.values())
    short = [group >> 32 for group, w in steps.items() if sum(w) < packing.STEP_TOKENS]
    assert len(short) == len(set(short))  # one of a partition at most
    assert packing.pack_documents(empty, vocabulary()).count() == 0


@pytest.mark.parametrize("remainders", [1024, 3])
def test_packing_merges_what_partitions_leave(spark, docs, rows, remainders):
    pieces = packing.pack_documents(docs.repartition(13), vocabulary(), remainders=remainders).collect()
    check_pieces(pieces, rows)
    windows = {p.sequence_id: p.window for p in pieces}
    level = max(windows) >> 58
    assert level == (1 if remainders == 1024 else 3)
    below = [s for s, w in windows.items() if w < packing.TIERS[-1]]
    assert all(s >> 58 == level for s in below) and sum(windows[s] for s in below) < packing.TIERS[-1]


def test_packer_fills_gaps_from_shorter_tiers():
    p = packing.Packer(0, tiers=(16, 8, 4), pool=1 << 20)
    for i, n in enumerate([13, 3, 9, 5, 40, 2, 7, 1]):
        p.add(i, bytes(4 * n))
    p.pack(last=True)
    p.balance()
    windows = {}
    for doc, start, length, ids, total, sequence, offset, window, step in p.take():
        windows.setdefault(sequence, [window, 0])[1] += length
    assert all(a == b for a, b in windows.values()) and sum(b for _, b in windows.values()) == 80
    assert not p.docs


def test_packer_balances_step_groups():
    p = packing.Packer(0, tiers=(16, 8, 4), pool=8, step_tokens=64)
    rng = random.Random(1)
    for i in range(200):
        p.add(i, bytes(4 * rng.randint(1, 30)))
    p.pack(last=True)
    p.balance()
    groups = {}
    for *_, sequence, offset, window, group in p.take():
        groups.setdefault(group, {})[sequence] = window
    sums = [sum(w.values()) for w in groups.values()]
    assert sum(n < 64 for n in sums) <= 1 and max(sums) == 64


def test_secrets(docs, empty, rows):
    got = by_id(secrets.digest(docs))
    for i, t in rows:
        want = sorted(plain.spans(t, plain.SECRETS), key=lambda x: (x[2], x[0]))
        assert got[i].base_sha256 == hexed(",".join(f"{n}:{a}:{b}" for _, n, a, b in want)), (i, t, got[i].spans)
    assert secrets.digest(docs).count() == docs.count() and secrets.digest(empty).count() == 0
    out = secrets.redact(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    assert "hunter22x" not in "".join(r.text or "" for r in out.collect())


def test_secrets_ledger_scans_new_pairs_only(spark):
    docs = spark.createDataFrame([(1, "token=abcdef1"), (2, "token=abcdef1"), (3, "ghp_" + "Z" * 40), (4, None)], "doc_id long, text string")
    ledger = secrets.scan_blobs(docs.where("doc_id < 3")).cache()
    assert ledger.count() == 1
    assert secrets.scan_blobs(docs, ledger).count() == 2
    assert secrets.scan_blobs(docs, ledger, rule_version="next").count() == 3
    found = {r.doc_id: [(x.k, x.s, x.e) for x in r.f] for r in secrets.findings(docs, "f", ledger).collect()}
    assert found == {1: [(0, 0, 13)], 2: [(0, 0, 13)], 3: [(3, 0, 44)], 4: []}


def test_secrets_ledger_is_stored(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/ledger"
    docs = spark.createDataFrame([(1, "token=abcdef1"), (2, "token=abcdef1"), (3, None)], "doc_id long, text string")
    more = docs.unionByName(spark.createDataFrame([(4, "xoxb-" + "1" * 20 + " glpat-" + "a" * 20), (5, "eyJabcdefgh.abcdefgh.abcdefgh")], "doc_id long, text string"))
    assert secrets.stored(spark, path) is None
    first = secrets.digest(docs, path=path).collect()
    assert secrets.stored(spark, path).count() == 2
    scanned = []
    monkeypatch.setattr(secrets, "scan_blobs", lambda *a, f=secrets.scan_blobs, **k: scanned.append(f(*a, **k)) or scanned[-1])
    assert sorted(secrets.digest(docs, path=path).collect()) == sorted(first) and scanned[-1].count() == 0
    got = by_id(secrets.digest(more, path=path))
    assert secrets.stored(spark, path).count() == 4 and [got[i].spans for i in (1, 3, 4, 5)] == ["assign:0:13", "", "chat:0:25,forge:26:52", "jwt:0:29"]
    assert secrets.record(more, path, rule_version="next").where("rule_version = 'next'").count() == 4
    assert sorted(secrets.digest(docs).collect()) == sorted(first)


def test_language_against_plain_counts(spark):
    """The same model in plain dictionaries, on a table that the sample takes whole but for shared buckets."""
    rng = random.Random(2)
    parts = {"aa": ["ka", "lo", "mi", "pe", "ri"], "bb": ["sch", "tu", "lo", "gr", "wo"], "cc": ["ka", "tu", "xi", "pe", "zo"]}
    rows = []
    for i in range(300):
        lang = ["aa", "bb", "cc"][min(rng.randrange(12), 2)]  # cc is most, aa and bb are rare
        rows.append((i, " ".join("".join(rng.choice(parts[lang]) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(1, 12))), lang))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    held_out = lambda i: zlib.crc32(str(i).encode()) % 3 == 1
    train = [(r.lang, r.text) for r in langid.sample(docs.where(~langid.is_held_out(F.col("doc_id")))).collect()]
    texts = [(lang, t) for i, t, lang in rows if not held_out(i)]
    assert set(train) <= set(texts) and len(train) > 0.9 * len(texts)
    counts, totals = {}, {}
    for lang, t in train:
        for w in t.split():
            units = [(0, w)] + [(o, s[k : k + o]) for o in langid.ORDERS for s in [w if o == 1 else f"<{w}>"] for k in range(len(s) - o + 1)]
            for o, x in units:
                counts.setdefault((o, x), {}).setdefault(lang, 0)
                counts[o, x][lang] += 1
                totals[o, lang] = totals.get((o, lang), 0) + 1
    counts = {u: by for u, by in counts.items() if sum(by.values()) >= langid.MIN_COUNT}
    langs = sorted({lang for lang, _ in train})
    of = lambda o, x: np.array([np.log((counts[o, x].get(lang, 0) + 0.1) / (totals[o, lang] + 1)) for lang in langs])

    def unit(o, x):
        v = of(o, x)
        return v - v.mean()

    def word(w):
        if (0, w) in counts:
            return unit(0, w)
        for o in langid.ORDERS:
            s = w if o == 1 else f"<{w}>"
            found = [unit(o, s[k : k + o]) for k in range(len(s) - o + 1) if (o, s[k : k + o]) in counts]
            if found:
                return np.mean(found, axis=0)
        return np.zeros(len(langs))

    got = by_id(langid.identify(docs))
    for i, t, _ in rows:
        score = sum(word(w) for w in t.split())
        best = np.sort(score)
        if best[-1] - best[-2] > 1e-3:
            assert got[i].lang_pred == langs[int(np.argmax(score))]
    right = [got[i].lang_pred == lang for i, _, lang in rows if held_out(i)]
    assert sum(right) / len(right) > 0.85


def test_samples_do_not_shrink_with_the_table(spark):
    """A sample is drawn by least hashes, never by a share of a count: rare languages keep their rows."""
    big = spark.range(40_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("w"), F.col("id").cast("string")).alias("text"), F.when(F.col("id") % 2000 == 7, "rare").otherwise("main").alias("lang"))
    n = {r.lang: r["count"] for r in langid.sample(big, fit_docs=64).groupBy("lang").count().collect()}
    assert n["main"] == 64 and 10 <= n["rare"] <= 20
    copies = spark.range(30_000).select(F.lit(5).cast("long").alias("doc_id"), F.lit("one row over and over").alias("text"), F.lit("main").alias("lang"))
    assert langid.sample(copies, fit_docs=64).count() == 1


def test_language(spark, docs, empty):
    rng = random.Random(1)
    vocab = {"aa": ["kala", "mulo", "peri"], "bb": ["schtu", "grenz", "wolf"]}
    rows = [(i, " ".join(rng.choice(vocab[lang]) for _ in range(20)), lang) for i in range(400) for lang in [["aa", "bb"][i % 2]]]
    rows += [(400, None, "aa"), (401, "123 ½ ...", "bb"), (402, "kalamulo kalaperi", None), (403, "grenzwolf schtugrenz", "zz" * 0 or None)]
    got = by_id(langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")))
    assert all(got[i].lang_pred == lang for i, _, lang in rows[:400])
    assert (got[400].lang_pred, got[401].lang_pred, got[402].lang_pred, got[403].lang_pred) == ("und", "und", "aa", "bb")
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= got[i].score <= 1 for i, _, _ in rows)
    assert langid.identify(docs).count() == docs.count() and langid.identify(empty).count() == 0


@pytest.mark.parametrize("direct", [1, 5, 512])
def test_suffix_arrays(direct, monkeypatch):
    """Also where reduced strings are written in digits at every depth."""
    monkeypatch.setattr(suffix, "DIRECT", direct)
    rng = random.Random(2)
    for _ in range(200):
        symbols = rng.choice([1, 2, 3, 30])
        t = [rng.randint(1, symbols) for _ in range(rng.randint(1, 200))]
        t = (t[: rng.randint(1, 6)] * 20)[: len(t)] if rng.random() < 0.3 else t
        t.append(0)
        order = suffix.suffix_array(np.array(t, np.int32), symbols + 1).tolist()
        assert order == sorted(range(len(t)), key=lambda i: t[i:])
        shared = suffix.common_prefixes(np.array(t, np.int32), np.array(order))
        for a, b in zip(order, order[1:]):
            n = next(k for k in range(len(t)) if t[a + k] != t[b + k])
            assert shared[b] == n


@pytest.mark.parametrize("options", [{}, {"blob_bytes": 3000, "shards": 5}, {"blob_bytes": 3000, "shards": 3, "hot_blobs": 1}, {"blob_bytes": 500, "shards": 2, "hot_blobs": 3}])
def test_substrings(docs, empty, options):
    held = [(r.doc_id, (r.text or "").encode()) for r in docs.collect()]
    gone = plain.repeats([((1 << 62) if i is None else i, t) for i, t in held])
    want = sorted((i is None, i or 0, len(t), sum(g), sum(1 for k in range(len(g)) if g[k] and (k == 0 or not g[k - 1])), hashlib.sha256(bytes(x for x, y in zip(t, g) if not y)).hexdigest()) for (i, t), g in zip(held, gone))
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in substrings.digest(docs, **options).collect())
    assert got == want
    if not options:
        assert substrings.digest(empty).count() == 0


def test_substrings_of_copies(spark):
    """Whole copies in several blobs, with repeated, null and negative ids, and texts of no window."""
    rng = random.Random(7)
    text = lambda n: "".join(rng.choice("abcd ") for _ in range(n))
    a, b, c = text(120), text(300), text(49)
    rows = [(4, a), (2, a), (2, a), (None, a), (-3, b), (8, b + a), (9, a + b), (9, a + b), (10, c), (1, c), (11, c + a), (None, text(60)), (12, None), (13, "é" * 40), (-13, "é" * 40)]
    rows += [(20 + i, t) for i in range(30) for t in (a, b)]
    held = [((1 << 62) if i is None else i, (t or "").encode()) for i, t in rows]
    want = sorted((i, len(t), sum(g), sum(1 for k in range(len(g)) if g[k] and (k == 0 or not g[k - 1])), hashlib.sha256(bytes(x for x, y in zip(t, g) if not y)).hexdigest()) for (i, t), g in zip(held, plain.repeats(held)))
    got = substrings.digest(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), blob_bytes=400, shards=3)
    assert sorted(((1 << 62) if r.doc_id is None else r.doc_id, *r[1:]) for r in got.collect()) == want


def test_substrings_leave_copies_out():
    """Of texts that a lesser id has whole, in the blob or in another one, no gram is sent."""
    rng = random.Random(8)
    a, b, c = ("".join(rng.choice("abcdefgh") for _ in range(200)).encode() for _ in range(3))
    blobs = {1: ([5, 9, 9], [a, b, a]), 2: ([7, 3, 11], [a, b, c])}
    held = {k: substrings.Blob.packed(*x) for k, x in blobs.items()}
    batch = pa.RecordBatch.from_arrays([pa.array(list(held)), pa.array(list(held.values()), pa.binary())], names=["blob", "data"])
    flat = lambda batches: sorted((tuple(r.values()) for x in batches for r in x.to_pylist()), key=lambda r: r[:3])
    sent = flat(substrings.send_texts(2)([batch]))
    told = flat(substrings.known_texts(substrings.table([r]) for r in sent))
    copies = {k: substrings.Blob(x).copies([r[3] for r in told if r[0] == k]).tolist() for k, x in held.items()}
    assert copies == {1: [False, True, True], 2: [True, False, False]}
    rows = sorted(told + [(k, 2, k, x) for k, x in held.items()], key=lambda r: r[:2])
    grams = {k: np.concatenate([substrings.wide(r[3]) for r in flat(substrings.send_grams(1)([substrings.table(rows)])) if r[2] == k]) for k in held}
    assert not set(grams[1].tolist()) & set(grams[2].tolist())


def test_only_contexts_that_can_meet_are_sorted(monkeypatch):
    """Contexts of one gram that differ on both sides of it need no suffix array; others do, wherever the gram stands."""
    sorted_ = []
    whole = substrings.least_ids
    monkeypatch.setattr(substrings, "least_ids", lambda contexts, ids: sorted_.append(len(contexts)) or whole(contexts, ids))
    rng = random.Random(9)
    word = lambda n: bytes(rng.choice(b"abcdefghijklmnop") for _ in range(n))
    texts = [word(3000) for _ in range(2)]
    held = substrings.Contexts(substrings.Blob(substrings.Blob.packed([0, 1], texts)))
    at = int(np.argmax(held.n[: np.searchsorted(held.doc, 1)]))
    first, n = int(held.start[at]), int(held.n[at])
    context = texts[0][first : first + n + substrings.LENGTH - 1]
    h = substrings.hashes(np.frombuffer(context, np.uint8), substrings.GRAM)
    place = int(np.argmin(h))
    other = lambda keep: bytes(c if place - keep <= k < place + substrings.GRAM + keep else ord("q") for k, c in enumerate(context))
    ids = np.array([3, 1], np.int64)
    for two, arrays in ((other(4), []), (other(40)[:-1] + b"q", [2])):
        sorted_.clear()
        least = substrings.least_by_window([context, two], ids, np.array([n, n]))
        shared = [context[k : k + 50] == two[k : k + 50] for k in range(n)]
        assert least.tolist() == [1 if x else 3 for x in shared] + [1] * n
        assert sorted_ == arrays


@pytest.mark.parametrize("letters", [b"a", b"ab", b"abc"])
def test_least_by_window_of_periods(letters):
    """Grams that stand at many places of a context."""
    rng = random.Random(10)
    contexts = list({bytes(rng.choice(letters) for _ in range(rng.randint(1, 4))) * 40 for _ in range(12)} | {bytes(rng.choice(letters) for _ in range(50)) for _ in range(3)})
    contexts = [c[: rng.randint(50, 90)] for c in contexts]
    contexts = list(dict.fromkeys(c for c in contexts if len(c) >= 50 and len({int(x) for x in substrings.windows(np.frombuffer(c, np.uint8))}) == 1))
    ids = np.array([rng.randint(0, 9) for _ in contexts], np.int64)
    n = np.array([len(c) - 49 for c in contexts])
    least = {}
    for c, i in zip(contexts, ids.tolist()):
        for k in range(len(c) - 49):
            least[c[k : k + 50]] = min(i, least.get(c[k : k + 50], 99))
    want = [least[c[k : k + 50]] for c in contexts for k in range(len(c) - 49)]
    assert substrings.least_by_window(contexts, ids, n).tolist() == want


def test_simhash(docs, empty, rows):
    got = by_id(simhash.digest(docs))
    prints = {i: plain.fingerprint(t) for i, t in rows}
    want = plain.components(prints)
    assert {i: (got[i].fingerprint, got[i].component_id) for i in prints} == {i: (f"{prints[i]:016x}", want[i]) for i in prints}
    kept = simhash.deduplicated(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(set(want.values()))
    assert simhash.digest(empty).count() == 0 and simhash.deduplicated(empty).count() == 0


def test_simhash_splits_hot_shards(spark):
    rng = random.Random(3)
    center = rng.getrandbits(64)
    prints = {center ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for _ in range(400)} | {rng.getrandbits(64) for _ in range(100)}
    signed = [(x - (1 << 64) if x >> 63 else x,) for x in prints]
    found = simhash.components(simhash.links(spark.createDataFrame(signed, "fp long"), shard_rows=8))
    root = {r.v & (1 << 64) - 1: r.root & (1 << 64) - 1 for r in found.collect()}
    groups, want = {}, {}
    for x, top in plain.components({x: x for x in prints}).items():
        want.setdefault(top, set()).add(x)
    for x in prints:
        groups.setdefault(root.get(x, x), set()).add(x)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_token_counts(docs, empty, rows):
    t = Tokenizer.from_file(vocabulary())
    got = by_id(bpe.token_counts(docs, vocabulary(), limit=50))
    for i, text in rows:
        n = len(t.encode(text or "", add_special_tokens=False).ids)
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len((text or "").encode()), n, n > 50), text
    assert bpe.token_counts(empty, vocabulary()).count() == 0


PAGES = {
    0: ("<nav><a href=/>Home page</a></nav><article><h1>T &amp; x</h1><p>One  two<p>Three &lt;b&gt; <b>four</b></article><footer>&copy; me</footer>", "T & x\nOne two\nThree <b> four"),
    1: ("<html><body><div class='ad'>Buy now.</div><article><p>Body text of the page.</p><ul><li>item one<li>item two</ul></article><aside><p>More links here.</p></aside><script>var a='<p>x</p>';</script></body>", "Body text of the page.\nitem one\nitem two"),
    2: ("", ""),
    3: (None, ""),
    4: ("<header><p>Site name</p></header><main><p>Main text is here, and it goes on.</p></main><section class='comments'><p>Nice post!</p></section><form><p>Sign up</p></form>", "Main text is here, and it goes on."),
}


def test_html(spark):
    schema = "page_id long, url string, html string, id string, text string, n_chars string"
    rows = [(i, None if i == 3 else f"u{i}", h, "x", "y", None) for i, (h, _) in PAGES.items()]
    pages = spark.createDataFrame([*rows, *rows, *((i + 10, u, *rest) for i, u, *rest in rows)], schema)
    got = html_text.extract(pages).collect()
    assert len(got) == 3 * len(PAGES)
    for r in got:
        want = PAGES[r.page_id % 10][1]
        assert (r.text, r.n_chars) == (want, len(want)), r
    assert html_text.extract(spark.createDataFrame([], schema)).count() == 0


def test_html_blocks_of_broken_markup():
    texts = lambda html: [b[2] for b in html_text.blocks(html)]
    assert texts("a<p>b<div>c</p>d</div><!-- no --><table><tr><td>e<td>f</table>&amp g &#x41;<p title='>'>h<script>x") == ["a", "b", "c", "d", "e", "f", "& g A", "h"]
    assert texts("<p title=it's>hello<p class=\"a b>c</p>d") == ["hello", "c", "d"]
    assert texts("a </3>b<p>c<!-- d") == ["a b", "c"] and texts("1 < 2 <p>x <b") == ["1 < 2", "x"]
    assert texts("<ul><li>a<li>b<ul><li>c</ul></ul><dl><dt>d<dd>e</dl>") == ["a", "b", "c", "d", "e"]


def test_html_of_hostile_pages_takes_linear_time():
    cases = ["<b>x<br>", "<a x", "<i>", "<div>", "<p></p><b>", "</q>", "<!", "<a x='", "<td><b>", "<x y=\"'"]
    for case in cases:
        began = time.time()
        html_text.blocks(case * 4_000)
        middle = time.time()
        html_text.blocks(case * 32_000)
        assert time.time() - middle < 24 * (middle - began) + 0.5, case


def test_html_long_pages_in_chunks():
    model = html_text.Labeller()
    model.train([(html_text.vectors(p), np.array(y, np.float32)) for p, y in html_text.generated(40)], epochs=2)
    page = [b for p, _ in html_text.generated(30, seed=5) for b in p]
    whole, parts = model.scored([page, page[:7]]), model.scored([page, page[:7]], chunk=16)
    assert np.abs(whole[0] - parts[0]).max() < 1e-3 and np.abs(whole[1, :7] - parts[1, :7]).max() < 1e-3
    one = model.scored([page[:7]])
    assert np.abs(one[0] - whole[1, :7]).max() < 1e-3


def test_html_accuracy_by_construction():
    """Blocks of pages whose labels are known by construction: new pages, and layouts with unseen container names."""
    model = html_text.Labeller()
    model.train([(html_text.vectors(p), np.array(y, np.float32)) for p, y in html_text.generated(html_text.GENERATED)])

    def accuracy(pages):
        labels = model.label([p for p, _ in pages])
        return np.mean(np.concatenate([a == np.array(y) for a, (_, y) in zip(labels, pages)]))

    assert accuracy(html_text.generated(150, seed=99)) > 0.97
    assert accuracy(html_text.generated(150, seed=98, other_names=["zz9", "colleft", "xq"])) > 0.9


def test_labeller_gradients():
    model = html_text.Labeller()
    pages = [(html_text.vectors(p), np.array(y, np.float32)) for p, y in html_text.generated(3)]
    x, mask, y = html_text.batch(pages)

    def loss():
        q = html_text.sigmoid(model.scores(x, mask))
        return float((-(y * np.log(q) + (1 - y) * np.log(1 - q)) * mask).sum() / mask.sum())

    for w, g in zip(model.w, model.gradients(x, mask, y)):
        at = int(np.argmax(np.abs(g)))
        flat, was = w.reshape(-1), w.reshape(-1)[at]
        flat[at] = was + 1e-2
        up = loss()
        flat[at] = was - 1e-2
        down = loss()
        flat[at] = was
        assert abs((up - down) / 2e-2 - g.reshape(-1)[at]) < 1e-3


def held(item, text):
    """Whether some window of a text holds the item, its question or its answer, by plain sets."""
    tokens = decontaminate.words(text)
    units = [u for n, u in enumerate((decontaminate.words(item), *decontaminate.parts_of(item))) if len(u) >= (8 if n else 1)]
    grams = lambda w, n: {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}

    def within(span):
        for p in range(len(tokens) // span + 1):
            window = tokens[p * span : (p + 2) * span]
            for u in units:
                mine = grams(u, min(5, len(u)))
                if len(mine & grams(window, min(5, len(u)))) >= 0.8 * len(mine):
                    return True
        return False

    return within


def test_decontamination(spark, docs, empty, rows):
    rng = random.Random(4)
    hosts = [t for _, t in rows if t and 20 < len(t.split()) < 400]
    items = [(100 + k, " ".join(rng.choice(hosts).split()[:n])) for k, n in enumerate([60, 40, 25, 12, 8, 5, 3])] + [(200, None), (201, "..."), (202, "Quite other words that no document holds at all. An answer.")]
    table = spark.createDataFrame([(i, t, "x", 1.0) for i, t in items], "item_id long, text string, doc_id string, score double")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, table).collect() if r.doc_id is not None}
    span = max([64, *(len(decontaminate.words(t)) for _, t in items)])
    want = {(i, k) for i, t in rows for k, item in items if decontaminate.words(item) and held(item, t)(span)}
    assert got == want and len(want) > 10
    kept = decontaminate.clean(docs, table)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, _ in rows} - {i for i, _ in got} | ({None} if 14 not in {i for i, _ in got} else set())
    assert decontaminate.contaminated(empty, table).count() == 0
    assert decontaminate.contaminated(docs, table.limit(0)).count() == 0
    assert decontaminate.clean(docs, table.limit(0)).count() == docs.count()


def test_decontamination_by_question_or_answer(spark):
    rng = random.Random(8)
    prose = lambda n: " ".join(f"w{rng.randrange(10**5)}" for _ in range(n))
    questions = [(k, prose(12), prose(10)) for k in range(60)]
    items = spark.createDataFrame([(k, f"Say {q}? It is {a}.") for k, q, a in questions] + [(99, f"Say {prose(9)}? Yes it is.")], "item_id long, text string")
    texts = [prose(3000) + f" say {questions[1][1]} " + prose(3000), prose(40) + f" it is {questions[2][2]} " + prose(9), prose(50) + " yes it is " + prose(50), f"say {questions[3][1]} it is {questions[3][2]}"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for size in (1, 1 << 20):  # in many blocks, and in one
        got = {(r.doc_id, r.item_id): r for r in decontaminate.contaminated(docs, items, index_bytes=size).collect()}
        assert set(got) == {(0, 1), (1, 2), (3, 3)}
        assert got[0, 1].question_overlap == 1 and got[0, 1].answer_overlap == 0 and got[1, 2].answer_overlap == 1 and got[3, 3].overlap == 1
        assert [r.doc_id for r in decontaminate.clean(docs, items, index_bytes=size).collect()] == [2]


def test_wand_returns_all_above_threshold():
    rng = random.Random(6)
    vocab = [f"w{k}" for k in range(60)]
    items = [(k, " ".join(rng.choices(vocab, weights=range(1, 61), k=rng.randint(3, 20)))) for k in range(120)]
    index = decontaminate.Index(items)
    for _ in range(60):
        query = set(rng.sample(vocab, rng.randint(1, 40)))
        score = {}
        for term in query & index.terms.keys():
            for unit, v in zip(*index.postings(index.terms[term])[:2]):
                score[unit] = score.get(unit, 0) + v
        want = {k: s for k, s in score.items() if s >= 1}
        assert {k: round(s, 9) for k, s in index.search(query)} == {k: round(s, 9) for k, s in want.items()}


def test_simhash_decides_by_row(spark):
    rng = random.Random(11)
    prose = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(40)) for _ in range(6)]
    lone = [(None, t) for t in prose[:3]]
    rows = [*lone, (1, prose[3]), (1, prose[3]), (2, prose[3]), (2, prose[4]), (3, prose[4]), (4, prose[5])]
    kept = simhash.deduplicated(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, kept.collect()), key=str) == sorted([*lone, (1, prose[3]), (2, prose[4]), (4, prose[5])], key=str)


def test_quality_keeps_long_paragraphs_with_a_hit(spark):
    rng = random.Random(12)
    prose, more = (" ".join(f"w{rng.randrange(10**6)}" for _ in range(60)) for _ in range(2))
    long = [prose + middle + more + "." for middle in (" it stores cookies and runs javascript here ", " a | b | c | d ")]
    short = ["We use cookies to give you the best experience on our website.", "Home > Products > Outdoor shoes > Boots for the winter", "Accept cookies, read our privacy policy and terms of service, or log in or subscribe to read more about what we do with your data and why."]
    docs = spark.createDataFrame([*enumerate(long), (2, prose + ".\n" + "\n".join(short))], "doc_id long, text string")
    got = by_id(quality.rules(docs))
    assert [got[i].kept for i in range(3)] == [True] * 3 and [got[i].clean_text for i in range(3)] == [*long, prose + "."]
    assert {r.doc_id: r.text for r in quality.clean(docs).collect()} == {i: got[i].clean_text for i in range(3)}


def test_secrets_are_found_whole(spark):
    rng = random.Random(13)
    body = "\n".join("".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz+/", k=64)) for _ in range(200))
    headers = "Proc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,0A1B2C\n\n"
    begin, end = "-----BEGIN RSA PRIVATE KEY-----\n", "\n-----END RSA PRIVATE KEY-----"
    login = "https://" + "u" * 90 + ":" + "p" * 90 + "@"
    texts = ["so " + begin + body + end + " on", "so " + begin + headers + body + end + " on", "so " + begin + headers + body + "; on", f"so {login}host on", begin * 2 + body + end]
    want = ["so [pem] on", "so [pem] on", "so [pem]; on", "so [login]host on", "[pem][pem]"]
    docs = spark.createDataFrame([*enumerate(texts), (5, begin.strip() * 1_000)], "doc_id long, text string")
    got = {r.doc_id: r.text for r in secrets.redact(docs).collect()}
    assert [got[i] for i in range(5)] == want and got[5] == "[pem]" * 1_000


def test_secret_headers_of_any_length_and_failed_scans(spark, tmp_path, monkeypatch):
    key = "-----BEGIN {0}PRIVATE KEY-----\nQUJD\n-----END {0}PRIVATE KEY-----"
    texts = [key.format(""), key.format("SOME VERY LONG LABEL OF A MAKER OF KEYS "), key.format("X25519 "), key.format("A " * 50_000), key.format("PUBLIC ").replace("PRIVATE", "SHARED")]
    docs = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.text for r in secrets.redact(docs).collect()}
    assert [got[i] for i in range(4)] == ["[pem]"] * 4 and got[4] == texts[4]
    path = tmp_path / "ledger"
    monkeypatch.setattr(secrets, "scan_blobs", lambda *a, **k: docs.select(F.raise_error(F.lit("lost")).alias("blob_id")))
    with pytest.raises(Exception, match="lost"):
        secrets.record(docs, f"file://{path}")
    assert not [f for f in path.iterdir() if f.name.startswith("_new-")]


def test_pii_candidates_do_not_depend_on_other_text(spark):
    models = {k: (boosting.fit({0: (1.0, 1.0)}, pii.FEATURES), -1e9) for k in range(len(pii.KINDS))}
    texts = ["write to joe at example.com today", "host ab:cd:ef:ab:cd:ef:ab:cd is up", "joe [at] example [dot] com", "meet me at noon"]
    docs = spark.createDataFrame([*enumerate(texts), *((10 + i, t + " or 7") for i, t in enumerate(texts))], "doc_id long, text string")
    got = by_id(pii.digest(docs, models=models))
    assert [got[i].spans for i in range(4)] == [got[10 + i].spans for i in range(4)] == ["email:9:27", "ip:5:28", "email:0:26", ""]
