"""Scalar functions on text, as column expressions.

All patterns repeat possessively, so Java's engine neither recurses nor backtracks on long runs.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that the index leaves out.
STOPWORDS = (
    "a an the of and or to in for on at by is are be been being as with from that this these those "
    "it its shall should may can will would could not no if then than when where which who whom what "
    "such other any all each per via into over under between within"
).split()

#: The token, clause and annex grammars.
TOKEN = r"[a-z0-9]++(?:[-.][a-z0-9]++)*+"
SIZING_TOKEN = r"[A-Za-z0-9]++(?:[-.'][A-Za-z0-9]++)*+"
WORD = r"[A-Za-z0-9]++(?:[-'][A-Za-z0-9]++)*+"
CLAUSE = r"^(?:\d+|[A-Z])[A-Za-z]?(?:\.\d+[A-Za-z]?)*$"
ANNEX = r"(?i)^Annex\s+([A-Z][A-Z0-9]*)\s*(?:\(([^)]*)\))?\s*:?\s*(.*)$"
#: Paragraph styles that are list items, and prefixes of styles that are left out.
BULLET_STYLES = ("B1", "B2", "B3", "B4", "B5")
DROPPED_STYLES = ("TOC", "TAN")


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def once(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once a row, also where lambdas inside use it for every element."""
    return F.transform(F.array(value), body)[0]


def tokens(text: Column | str, keep_stopwords: bool = False) -> Column:
    """Index tokens in order: each whole identifier, then its parts; stop-words left out unless kept."""
    wanted = (lambda t: F.lit(True)) if keep_stopwords else (lambda t: ~t.isin(STOPWORDS))
    whole = F.filter(F.regexp_extract_all(F.lower(col(text)), F.lit(TOKEN), F.lit(0)), wanted)
    parts = lambda t: F.filter(F.split(t, "[-.]"), lambda p: (F.length(p) > 1) & wanted(p))
    return F.flatten(F.transform(whole, lambda t: F.when(t.rlike("[-.]"), F.concat(F.array(t), parts(t))).otherwise(F.array(t))))


def count_tokens(text: Column | str) -> Column:
    """Number of sizing tokens: case kept, no parts, no stop-words taken out."""
    return F.regexp_count(col(text), F.lit(SIZING_TOKEN))


def normalised(text: Column | str) -> Column:
    return F.regexp_replace(F.lower(col(text)), r"(?U)\s+", " ")


def unit(vector: Column | str) -> Column:
    """The vector divided by its length, which counts as 1e-9 at least."""
    v = col(vector)
    length = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.transform(F.zip_with(v, F.array_repeat(F.greatest(length, F.lit(1e-9)), F.size(v)), lambda x, n: x / n), lambda x: x.cast("double"))


def sigmoid(x: Column | str) -> Column:
    return 1 / (1 + F.exp(-col(x)))


def model_prefix(model: str, query: bool) -> str:
    """What text models of two families expect in front of a query or a passage (fixed values)."""
    name = model.lower()
    if "e5" in name:
        return "query: " if query else "passage: "
    if "bge" in name and query:
        return "Represent this sentence for searching relevant passages: "
    return ""


# --- versions and places of archives ---------------------------------------------------------


def decode_version(code: Column | str) -> Column:
    """Three base-36 digits as struct (major, minor, patch); null for any other code."""
    c = F.lower(col(code))
    digit = lambda i: F.conv(F.substring(c, i, 1), 36, 10).cast("int")
    return F.when(c.rlike("^[0-9a-z]{3}$"), F.struct(digit(1).alias("major"), digit(2).alias("minor"), digit(3).alias("patch")))


def format_version(version: Column) -> Column:
    return F.concat_ws(".", version["major"], version["minor"], version["patch"])


def encode_version(version: Column | str) -> Column:
    """The code of a version of three parts up to 35 each; null for any other text."""
    v = col(version)
    digit = lambda i: F.lower(F.conv(F.get(F.split(v, r"\."), i), 10, 36))
    part = "(?:[0-9]|[12][0-9]|3[0-5])"
    return F.when(v.rlike(rf"^{part}\.{part}\.{part}$"), F.concat(digit(0), digit(1), digit(2)))


def series_of(spec_id: Column | str) -> Column:
    return F.concat(F.substring_index(col(spec_id), ".", 1), F.lit("_series"))


def flat_id(spec_id: Column | str) -> Column:
    return F.replace(col(spec_id), F.lit("."), F.lit(""))


def archive_url(base: str, spec_id: Column | str, version: Column | str) -> Column:
    """Where a version's archive lies below ``base``; empty where the version has no code."""
    s, code = col(spec_id), encode_version(version)
    url = F.concat_ws("/", F.lit(base), series_of(s), s, F.concat(flat_id(s), F.lit("-"), code, F.lit(".zip")))
    return F.when(code.isNotNull(), url).otherwise(F.lit(""))


def part_order(name: Column | str) -> Column:
    """Sort key of a part of an archive: its number behind the version code, 999 if there is none."""
    number = F.regexp_extract(F.lower(col(name)), r"-[0-9a-z]{3}_(\d+)_", 1)
    return F.struct(F.coalesce(number.try_cast("int"), F.lit(999)).alias("number"), F.lower(col(name)).alias("name"))


# --- headings and paragraphs ------------------------------------------------------------------


def heading_level(style: Column | str) -> Column:
    return F.regexp_extract(col(style), r"(?i)^heading\s*([1-9])$", 1).try_cast("int")


def split_heading(text: Column | str) -> Column:
    """struct (number, heading): a clause number before the first tab, an annex letter, or no number."""
    t = F.btrim(col(text), F.lit(" \t\r\n"))
    parts = F.filter(F.transform(F.split(t, "\t"), lambda p: F.trim(p)), lambda p: p != "")
    head = F.coalesce(F.get(parts, 0), F.lit(""))
    rest = F.array_join(F.slice(parts, 2, 1 << 20), " ")
    flat = F.translate(t, "\t", " ")
    numbered, annex = head.rlike(CLAUSE), flat.rlike(ANNEX)
    number = F.when(numbered, head).when(annex, F.regexp_extract(flat, ANNEX, 1)).otherwise(F.lit(""))
    heading = F.when(numbered, F.trim(rest)).when(annex, F.trim(F.regexp_extract(flat, ANNEX, 3))).otherwise(F.array_join(parts, " "))
    return F.struct(number.alias("number"), heading.alias("heading"))


def rendered(style: Column | str, text: Column | str) -> Column:
    """Paragraph text with spaces and tabs collapsed apart, list items marked; null if it is left out."""
    s = col(style)
    t = F.btrim(F.regexp_replace(F.regexp_replace(col(text), " {2,}", " "), "\t{2,}", "\t"), F.lit(" \t\r\n"))
    item = F.concat(F.repeat(F.lit("  "), F.substring(s, 2, 1).try_cast("int") - 1), F.lit("- "), F.btrim(F.regexp_replace(t, r"^[-\t ]+", ""), F.lit(" \t\r\n")))
    dropped = reduce(lambda a, b: a | b, (s.startswith(p) for p in DROPPED_STYLES))
    return F.when(dropped | (t == ""), F.lit(None)).when(s.isin(*BULLET_STYLES), item).otherwise(t)


def markdown(rows: Column | str) -> Column:
    """A table as markdown: rows padded to the widest, pipes escaped, the first row as header."""
    r = col(rows)
    width = F.array_max(F.transform(r, lambda x: F.size(x)))
    cell = lambda c: F.trim(F.replace(F.replace(c, F.lit("\n"), F.lit(" ")), F.lit("|"), F.lit("\\|")))
    padded = F.transform(r, lambda x: F.concat(F.transform(x, cell), F.array_repeat(F.lit(""), width - F.size(x))))
    lines = F.transform(padded, lambda x: F.concat(F.lit("| "), F.array_join(x, " | "), F.lit(" |")))
    rule = F.concat(F.lit("|"), F.array_join(F.array_repeat(F.lit("---"), width), "|"), F.lit("|"))
    return F.when(F.size(r) == 0, F.lit("")).otherwise(F.array_join(F.concat(F.slice(lines, 1, 1), F.array(rule), F.slice(lines, 2, 1 << 20)), "\n"))


def table_text(rows: Column | str) -> Column:
    """A table as plain lines of its non-empty cells."""
    lines = F.transform(col(rows), lambda x: F.array_join(F.filter(x, lambda c: c != ""), " — "))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def label(number: Column, heading: Column) -> Column:
    return F.trim(F.concat(number, F.lit(" "), heading))


def breadcrumb(ancestors: Column, number: Column, heading: Column) -> Column:
    trail = F.transform(ancestors, lambda a: label(a["number"], a["heading"]))
    return F.array_join(F.concat(trail, F.array(label(number, heading))), " > ")


def header(prefix: str, spec_id, version, release, clause, heading, part, parts, crumb) -> Column:
    """The provenance line and the path line of a chunk."""
    tag = F.concat(F.lit(prefix), spec_id, F.lit(" v"), version, F.lit(" (Rel-"), release.cast("string"), F.lit(")"))
    of = F.when(parts > 1, F.concat(F.lit(" [part "), (part + 1).cast("string"), F.lit("/"), parts.cast("string"), F.lit("]"))).otherwise(F.lit(""))
    return F.concat(tag, F.lit(" — clause "), clause, F.lit(" "), heading, of, F.lit("\nPath: "), crumb)


def citation(prefix: str, spec_id, version, clause, heading) -> Column:
    where = F.when(clause != "", clause).otherwise(heading)
    return F.concat(F.lit(prefix), spec_id, F.lit(" v"), version, F.lit(", clause "), where)


def clause_matches(actual: Column | str, expected: Column | str) -> Column:
    """Whether the clauses are equal or one is a dotted prefix of the other; never if one is empty."""
    a, e = col(actual), col(expected)
    dotted = lambda x, y: x.startswith(F.concat(y, F.lit(".")))
    return (a != "") & (e != "") & ((a == e) | dotted(a, e) | dotted(e, a))


# --- sentences --------------------------------------------------------------------------------


def chunk_sentences(text: Column | str) -> Column:
    return F.split(col(text), r"(?<=[.;:])\s+(?=[A-Z0-9(\[])")


def answer_sentences(text: Column | str) -> Column:
    return F.split(col(text), r"(?<=[.;])\s+(?=[A-Z0-9(\[])")
