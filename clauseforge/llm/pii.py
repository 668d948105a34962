"""Personal data by candidate gradient boosting, in built-in functions only.

High-recall generators propose candidates, many of which overlap: e-mail addresses also in
spelled-out form, number groups that may be cards or phones with or without a plus, dotted,
bracketed and coloned addresses. Boosted trees (``boosting``) score each candidate from format and
context features. The base spans always stay; candidates above the threshold of their kind that
overlap no base span are added.

The trees learn from drawn examples (``examples``): spans of each kind that the base rules do not
know, and look-alikes such as dates, times, version and order numbers, in contexts of both sorts.
Only candidates apart from base spans are learnt from, so the labels are not the base rules; no
feature is a base rule (the checksum, which every card passes, is one part of one). Thresholds are
calibrated on half of the examples. The model therefore does not depend on the table or its size.

Edge cases: null text counts as empty and has no spans; long texts are read whole, in time that
grows as their hits; repeated rows get the same spans; an empty table gives no row; columns other
than the id and the text are left alone.
"""

from __future__ import annotations

import random
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clauseforge.llm import boosting
from clauseforge.llm.common import fresh, let, quoted
from clauseforge.llm.spans import apart, found, listed, redacted

KINDS = ["email", "ip", "card", "phone"]
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
OCTET = "0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9]|)"
DOT = r"(?:\.|\x20?[\[(]dot[\])]\x20?|\x20dot\x20)"
#: Wider patterns whose matches the trees judge.
WIDE = {
    "email": rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?:@|\x20?[\[(]at[\])]\x20?|\x20at\x20)[A-Za-z0-9-]++(?:{DOT}[A-Za-z0-9-]++)*{DOT}[A-Za-z]{{2,6}}+(?![A-Za-z0-9-])",
    "ip": r"(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{3,4}+::[0-9A-Fa-f]{1,4}+(?![0-9A-Za-z:])|[0-9]{1,3}+(?:(?:\.|[\[(]\.[\])])[0-9]{1,3}+){3}+|[0-9A-Fa-f]{1,4}+(?:::?+[0-9A-Fa-f]{1,4}+){2,7}+)",
    "card": r"(?<![0-9])[0-9](?:[\x20.-]?+[0-9]){12,18}+(?![0-9])",
    "phone": r"(?<![0-9])[+(]?[0-9](?:[\x20().-]{0,2}+[0-9]){6,14}+(?![0-9])",
}
#: A text without any of these holds no match of the wider patterns.
MAY = r"[0-9@]|\bat\b|[A-Fa-f]:[A-Fa-f]|[A-Fa-f]::[A-Fa-f]"
#: Drawn examples of each kind, half of them look-alikes; half are learnt from, half calibrate.
EXAMPLES = 600
PRECISION = 0.98
CONTEXT = 24
FEATURES = 13
SPANS = "array<struct<k:int,s:int,e:int,m:string>>"

#: Words before a span that name it, and words before a number that is something else.
NAMED = {
    "email": ["mail ", "write to ", "contact: ", "reach me at ", "send it to "],
    "ip": ["host ", "address ", "client ip ", "the host at ", "from ip "],
    "card": ["card ", "visa ", "credit card: ", "pay with card no ", "my card is "],
    "phone": ["call ", "phone: ", "tel ", "mobile ", "reach us on "],
}
OTHER = ["order ", "invoice ", "version ", "isbn ", "section ", "page ", "article ", "order no. ", "sku ", "v ", "build ", "timestamp ", "ticket ", "serial ", "model ", "part no. ", "ref ", "lot "]
#: Words of prose, and words that addresses are made of.
PROSE = "meet look stay noon table home least once work night school first last them the that ease large sea dinner lunch work sat arrived was people looking stopped left and bubble".split()
NAMES = "joe anna mark smith lee info sales office mailbox acme example home garden studio".split()
PLAIN = ["", "then ", "it was ", "we saw ", "about ", "and "]


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(m: Column) -> Column:
    """Whether the digits of ``m`` pass the Luhn check."""
    values = F.transform(F.split(F.reverse(digits(m)), ""), lambda c, i: F.coalesce(c.try_cast("int"), F.lit(0)) * (1 + i % 2))
    return F.aggregate(F.transform(values, lambda v: F.when(v > 9, v - 9).otherwise(v)), F.lit(0), lambda a, v: a + v) % 10 == 0


def valid(k: int, m: Column) -> Column:
    if k == 1:
        return m.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")
    if k == 2:
        return F.length(digits(m)).between(16, 19) & luhn(m)
    if k == 3:
        return F.length(digits(m)).between(8, 15)
    return F.lit(True)


def base_spans(text: Column) -> Column:
    worth = [text.contains("@"), text.rlike("[0-9]"), text.rlike("[0-9]"), text.contains("+")]

    def of_kind(k: int) -> Column:
        hits = F.filter(found(text, BASE[KINDS[k]], worth[k]), lambda x: valid(k, x["m"]))
        return F.transform(hits, lambda x: F.struct(F.lit(k).alias("k"), x["s"].alias("s"), x["e"].alias("e"), x["m"].alias("m")))

    return F.concat(*map(of_kind, range(len(KINDS)))).cast(SPANS)


def features(k: int, x: Column) -> Column:
    """Bitmask of format and context features of the candidate ``x`` (m, l, r) of kind ``k``."""
    left, right, m = F.lower(x["l"]), x["r"], x["m"]
    named = r"(?:phone|tel|call|mobile|fax|card|visa|credit|mail|contact|write|send|reach|address|host|client|\bip)[^\x20]{0,4}\x20?[^\x20]{0,6}\x20?[^\x20]{0,3}\x20?$"
    other = r"(?:order|invoice|version|isbn|sku|article|section|page|build|timestamp|ticket|serial|model|part|\bref|\blot|no\.|nr\.|#|\bv)[.:]?\x20?(?:no\.?|number|is|was)?\x20?$"
    form = [r"(?i)[\[(]at[\])]", r"::", r"[\x20.-]", r"[\x20().-]"][k]
    shape = [
        r"(?i)\x20at\x20.*\x20dot\x20",
        r"(?i)^(?:[0-9a-f]{1,4}:){7}[0-9a-f]{1,4}$|[\[(]\.[\])]|^(?:fe[89ab][0-9a-f]|f[cd][0-9a-f]{2}|2[0-9a-f]{3}):.*[0-9]",
        r"^[0-9]{4}([\x20.-])[0-9]{4}\1[0-9]{4}\1[0-9]{4}$|^3[0-9]{3}[\x20.-]?[0-9]{6}[\x20.-]?[0-9]{4,5}$",
        r"^(?:1[\x20.-])?\(?[0-9]{3}\)?[\x20.-]{1,2}[0-9]{3}[\x20.-][0-9]{4}$|^\(0[1-9][0-9]{0,4}\)\x20?|^00?[1-9][0-9]{0,4}[\x20().-]",
    ][k]
    sign = [m.rlike(r"^\S*[0-9._+-]\S*\x20?[\[(]?at") | m.rlike(r"@"), m.rlike("[A-Fa-f]"), luhn(m), m.rlike(r"^[+(0]")][k]
    n = F.length(digits(m)) if k > 1 else F.length(m)
    tests = [
        (left == "") | left.rlike(r"[\s\"'(<\[:,;=]$"),
        (right == "") | right.rlike(r"[\s\"')>\].,;:!?]"),
        left.rlike(named),
        left.rlike(other),
        m.rlike(form),
        m.rlike(shape),
        sign,
        n >= 10,
        n >= 13,
        m.rlike(r"^(?:19|20)[0-9]{2}[\x20./-]|^[0-9]{1,2}[./-][0-9]{1,2}[./-](?:19|20)[0-9]{2}|^[0-9]{1,3}:[0-9]{1,3}:[0-9]{1,3}$|^(?:[0-9A-Fa-f]{2}:){5}[0-9A-Fa-f]{2}$"),
        m.rlike(r"^([0-9])(?:[^0-9]*\1)*$|^97[89]|^[0-9]{1,3}(?:[\x20.][0-9]{3})+$|^[0-9](?::[0-9A-Fa-f])+$"),
        m.rlike("^[3-6]"),
        m.rlike(r"^[0-9]{1,4}(?:\.[0-9]{1,4}){2,3}$|^[0-9]\.[0-9]{5,}$"),
    ]
    bits = F.lit(0)
    for i, t in enumerate(tests):
        bits = bits + F.when(t, 1 << i).otherwise(0)
    return bits


CANDIDATES = "array<struct<s:int,e:int,k:int,m:string,bits:int>>"


def candidates(text: Column, base: Column, kinds=range(len(KINDS))) -> Column:
    """Candidates (s, e, k, m, bits) of the wider patterns that overlap no base span."""
    worth = [text.rlike(r"@|\bat\b|[\[(]at"), text.rlike(r"[0-9]|[A-Fa-f]::?[A-Fa-f]"), text.rlike("[0-9]"), text.rlike("[0-9]")]

    def of_kind(k: int) -> Column:
        free = apart(found(text, WIDE[KINDS[k]], worth[k], CONTEXT), base)
        return F.transform(free, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.lit(k).alias("k"), x["m"].alias("m"), features(k, x).alias("bits")))

    return F.concat(*map(of_kind, kinds)).cast(CANDIDATES)


def checksummed(rng: random.Random, n: int, good: bool) -> str:
    """A number of ``n`` digits that passes the Luhn check, or does not."""
    body = [rng.choice("3456"), *(rng.choice("0123456789") for _ in range(n - 2))]
    total = sum(v - 9 if (v := int(c) * (2 - i % 2)) > 9 else v for i, c in enumerate(reversed(body)))
    return "".join(body) + str((-total + (0 if good else rng.randint(1, 9))) % 10)


def grouped(text: str, sizes: list[int], mark: str) -> str:
    out, at = [], 0
    for n in sizes:
        out.append(text[at : at + n])
        at += n
    return mark.join(x for x in out if x)


def drawn(rng: random.Random, kind: str, good: bool) -> str:
    """A span of the kind that no base rule knows, or a look-alike."""
    number = lambda n: str(rng.randint(10 ** (n - 1), 10**n - 1))
    word = lambda: "".join(rng.choice(["ba", "ke", "lo", "mi", "nu", "ra", "se", "ti"]) for _ in range(rng.randint(1, 3)))
    mark = rng.choice([" ", ".", "-"])
    hexed = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    if kind == "email":
        end = rng.choice(["com", "net", "org", "de"])
        at, dot = rng.choice([(" [at] ", " [dot] "), (" (at) ", " (dot) "), ("(at)", "."), ("[at]", "[dot]")])
        prose = f"{rng.choice(PROSE)} at {rng.choice(PROSE)}"
        return f"{word()}{at}{word()}{dot}{end}" if good else rng.choice([f"{prose} dot {rng.choice(['com', *PROSE])}", f"{prose} dot {end}", f"{prose}.{rng.choice(PROSE).title()}", f"look at {word()}.{end}", f"{word()} at {number(1)}.{number(2)}"])
    if kind == "ip":
        dot = rng.choice(["[.]", "(.)"])
        part = lambda: hexed(rng.randint(1, 4))
        if good:
            return rng.choice([dot.join(str(rng.randint(0, 255)) for _ in range(4)), ":".join(part() for _ in range(8)), "fe80::" + ":".join("f" + hexed(3) for _ in range(rng.randint(2, 4))), "2001:db8::" + ":".join("a" + hexed(2) for _ in range(rng.randint(1, 4))), rng.choice(["fe80", "2001", "fd00", "2a02"]) + "::" + number(rng.randint(1, 4))])
        return rng.choice([f"{rng.choice(['abc', 'cafe', 'add', 'face'])}::{rng.choice(['bad', 'de', 'fed'])}", f"{rng.randint(0, 23)}:{rng.randint(10, 59)}:{rng.randint(10, 59)}", ":".join(hexed(2) for _ in range(6)), ":".join(number(1) for _ in range(rng.randint(3, 6))), f"{rng.randint(256, 999)}.{number(2)}.{number(1)}.{number(3)}", f"{number(1)}.{number(3)}.{rng.randint(256, 999)}.{number(1)}"])
    if kind == "card":
        if good:
            n, sizes, between = rng.choice([(16, [4] * 4, "."), (15, [4, 6, 5], mark), (14, [4, 6, 4], mark), (15, [15], "")])
            text = checksummed(rng, n, True)
            return grouped(text, sizes, between)
        return rng.choice([grouped(checksummed(rng, 16, False), [4] * 4, mark), "978-3-" + grouped(number(9), [2, 6, 1], "-"), number(rng.randint(13, 19)), "20" + grouped(number(12), [2, 2, 8], mark), grouped(number(15), [3] * 5, mark)])
    if good:
        area, rest = number(3), (number(3), number(4))
        return rng.choice([f"({area}) {rest[0]}-{rest[1]}", f"{area}-{rest[0]}-{rest[1]}", f"{area}.{rest[0]}.{rest[1]}", f"1 ({area}) {rest[0]}-{rest[1]}", f"0044 20 {number(4)} {number(4)}", f"00{number(2)} {number(3)} {number(7)}", f"0{number(2)} {number(7)}", f"(0{number(2)}) {number(6)}", f"(0{number(3)}) {number(6)}"])
    year = str(rng.randint(1950, 2030))
    return rng.choice([f"{year}-{rng.randint(10, 12)}-{rng.randint(10, 28)}", f"{rng.randint(10, 28)}.{rng.randint(10, 12)}.{year}", f"{year}-{year}", number(rng.randint(7, 15)), f"{number(1)} {number(3)} {number(3)}", f"{number(1)}.{number(8)}", f"{number(2)}.{number(3)}.{number(3)}.{number(3)}", f"{year} {year} {year}"])


def examples(kind: str, n: int = EXAMPLES, seed: int = 17) -> list[tuple[str, bool]]:
    """Texts with one span of the kind or one look-alike each, and which of the two.

    What stands before a span decides where its form does not: an address that is spelled in words
    counts only behind a word that names it, and a third of the look-alikes have the form of a span
    behind the name of another number.
    """
    rng = random.Random(f"{kind} {seed}")
    out = []
    for i in range(n):
        good = i % 2 == 0
        before = rng.choice(NAMED[kind] * 3 + PLAIN if good else OTHER * 2 + PLAIN * 2)
        body = drawn(rng, kind, good)
        if good and kind == "email" and rng.random() < 0.25:
            before, body = rng.choice(NAMED[kind]), f"{rng.choice(NAMES)} at {rng.choice(NAMES)} dot {rng.choice(['com', 'org', 'net'])}"
        elif not good and rng.random() < 0.33:
            if kind != "email":
                before, body = rng.choice(OTHER), drawn(rng, kind, True)
            else:
                before = rng.choice(PLAIN)
        out.append((before + body + rng.choice(["", ".", " today", ", please", " and more"]), good))
    return out


def example_rows(spark: SparkSession, n: int = EXAMPLES, seed: int = 17) -> DataFrame:
    """Candidates (k, fold, bits, good) of the drawn examples."""
    rows = [(k, i % 4 // 2, good, text) for k, kind in enumerate(KINDS) for i, (text, good) in enumerate(examples(kind, n, seed))]
    table = spark.createDataFrame(rows, "k int, fold int, good boolean, text string").coalesce(1)
    table = table.withColumn("base", base_spans(F.col("text"))).withColumn("c", F.explode(candidates(F.col("text"), F.col("base"))))
    return table.where("c.k = k").select("k", "fold", "c.bits", "good")


@lru_cache(maxsize=4)
def fit(spark: SparkSession, n: int = EXAMPLES, seed: int = 17) -> dict[int, tuple[boosting.Boosted, float]]:
    """Model and threshold by kind, from the feature bitmasks of drawn examples."""
    table = example_rows(spark, n, seed).groupBy("k", "fold", "bits").agg(F.sum(F.col("good").cast("long")).alias("p"), F.count("*").alias("n"))
    counts: dict[tuple[int, int], dict[int, tuple[float, float]]] = {}
    for r in table.collect():  # at most one row an example
        counts.setdefault((r.k, r.fold), {})[r.bits] = (r.p, r.n - r.p)
    models = {}
    for k in range(len(KINDS)):
        model = boosting.fit(counts.get((k, 0), {0: (0.0, 0.0)}), FEATURES)
        models[k] = model, boosting.threshold(model, counts.get((k, 1), {}), PRECISION)
    return models


def accepted(models: dict) -> Column:
    """By kind which feature bitmasks the trees accept, 64 to a long."""

    def words(k: int) -> Column:
        model, least = models.get(k, (None, 2))
        held = [least <= 1 and model.probability(bits) >= least for bits in range(1 << FEATURES)]
        longs = [sum(1 << b for b in range(64) if held[a + b]) for a in range(0, 1 << FEATURES, 64)]
        return F.array(*(F.lit(x - (1 << 64) if x >> 63 else x).cast("long") for x in longs))

    return F.array(*map(words, range(len(KINDS))))


def find(docs: DataFrame, base: str, spans: str, text_col: str = "text", models: dict | None = None) -> DataFrame:
    """``docs`` with columns ``base`` (base spans) and ``spans`` (all spans), by kind and start."""
    models = fit(docs.sparkSession) if models is None else models
    text = F.coalesce(quoted(text_col), F.lit(""))
    good = accepted(models)

    def taken(c: Column) -> Column:
        return F.getbit(F.get(F.get(good, c["k"]), F.shiftright(c["bits"], 6)), c["bits"].bitwiseAND(63)) == 1

    def added(cs: Column) -> Column:
        return F.transform(F.filter(cs, taken), lambda c: F.struct(c["k"].alias("k"), c["s"].alias("s"), c["e"].alias("e"), c["m"].alias("m")))

    more = F.when(text.rlike(MAY), let(candidates(text, F.col(base)), added)).otherwise(F.array().cast(SPANS))
    return docs.withColumn(base, base_spans(text)).withColumn(spans, F.sort_array(F.concat(base, more.cast(SPANS))))


def redact(docs: DataFrame, text_col: str = "text", models: dict | None = None) -> DataFrame:
    """``docs`` with every span in the text replaced by its kind in brackets."""
    names, (base, spans) = F.array(*map(F.lit, KINDS)), fresh(docs, "_base", "_spans")
    by_start = F.transform(spans, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["k"].alias("k")))
    text = redacted(quoted(text_col), by_start, lambda x: F.concat(F.lit("["), F.get(names, x["k"]), F.lit("]")))
    return find(docs, base, spans, text_col, models).withColumn(text_col, text).select(*map(quoted, docs.columns))


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", models: dict | None = None) -> DataFrame:
    """Per row: the id, counts of base spans by kind, the hash of the base spans, and all spans."""
    rows = find(docs.select(quoted(id_col), quoted(text_col)), "_base", "_spans", text_col, models)
    return rows.select(
        id_col,
        *(count_of(k).alias(f"n_{kind}") for k, kind in enumerate(KINDS)),
        F.sha2(listed(F.col("_base"), KINDS), 256).alias("base_sha256"),
        listed(F.col("_spans"), KINDS).alias("spans"),
    )


def count_of(k: int) -> Column:
    return F.size(F.filter("_base", lambda x: x["k"] == k)).cast("long")
