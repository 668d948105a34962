"""Queries of archives, versions, headings, clauses, chunks and the lexicon."""

from __future__ import annotations

from pyspark.sql import functions as F

from clauseforge.functions import text as T
from clauseforge.operators import clauses as C
from clauseforge.plans.registry import query
from clauseforge.plans.search import questions
from clauseforge.sources import archives, store

D36 = "'0123456789abcdefghijklmnopqrstuvwxyz'"
#: Version codes made from ids: base-36 digits, some in capitals, some too long or with a hyphen.
CODED = """coded AS (SELECT doc_id, source, lang, CASE doc_id % 10 WHEN 0 THEN upper(c) WHEN 1 THEN c || '0' WHEN 2 THEN replace(c, substr(c, 2, 1), '-') ELSE c END AS code
FROM (SELECT doc_id, source, lang, CASE WHEN doc_id % 2 = 0 THEN translate(substr(md5(CAST(doc_id AS VARCHAR)), 1, 3), '0123456789abcdef', 'ghijklmnopqrstuv') ELSE substr(md5(CAST(doc_id AS VARCHAR)), 1, 3) END AS c FROM documents))"""


def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def coded(spark, sf_dir):
    d = F.col("doc_id")
    c = F.substring(F.md5(d.cast("string")), 1, 3)
    c = F.when(d % 2 == 0, F.translate(c, "0123456789abcdef", "ghijklmnopqrstuv")).otherwise(c)
    rows = documents(spark, sf_dir).withColumn("c", c)
    code = F.when(d % 10 == 0, F.upper("c")).when(d % 10 == 1, F.concat("c", F.lit("0"))).when(d % 10 == 2, F.replace("c", F.substring("c", 2, 1), F.lit("-"))).otherwise(F.col("c"))
    return rows.withColumn("code", code)


@query(
    "f1_versions",
    f"""WITH {CODED}, c AS (SELECT doc_id, code, lower(code) AS l, {D36} AS d, regexp_matches(lower(code), '^[0-9a-z]{{3}}$') AS good FROM coded)
SELECT doc_id, code, CASE WHEN good THEN concat_ws('.', instr(d, l[1]) - 1, instr(d, l[2]) - 1, instr(d, l[3]) - 1) END AS version, CASE WHEN good THEN l END AS encoded FROM c""",
)
def f1_versions(spark, sf_dir):
    v = T.decode_version("code")
    rows = coded(spark, sf_dir).select("doc_id", "code", F.when(v.isNotNull(), T.format_version(v)).alias("version"))
    return rows.withColumn("encoded", T.encode_version("version"))


@query("f4_archive_urls", "SELECT s || '' AS spec_id, 'http://a/' || split_part(s, '.', 1) || '_series/' || s || '/' || replace(s, '.', '') || '-f30.zip' AS url FROM (SELECT DISTINCT (20 + doc_id % 19) || '.' || (100 + doc_id % 31) AS s FROM documents)")
def f4_archive_urls(spark, sf_dir):
    d = F.col("doc_id")
    s = F.concat((20 + d % 19).cast("string"), F.lit("."), (100 + d % 31).cast("string"))
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select(s.alias("spec_id")).distinct()
    return rows.select("spec_id", T.archive_url("http://a", "spec_id", F.lit("15.3.0")).alias("url"))


#: A listing page for each of many specifications, with an archive for each document and one of another number.
SPEC = "(20 + doc_id % 5) || '.' || (100 + doc_id % 7)"
LISTED = f"""{CODED}, rows_ AS (SELECT DISTINCT {SPEC} AS spec_id, lower(code) AS version_code FROM coded WHERE regexp_matches(lower(code), '^[0-9a-z]{{3}}$')),
digits AS (SELECT *, instr({D36}, version_code[1]) - 1 AS a, instr({D36}, version_code[2]) - 1 AS b, instr({D36}, version_code[3]) - 1 AS c FROM rows_)"""


def listing(spark, sf_dir):
    spec = F.concat((20 + F.col("doc_id") % 5).cast("string"), F.lit("."), (100 + F.col("doc_id") % 7).cast("string"))
    rows = coded(spark, sf_dir).withColumn("spec_id", spec)
    link = F.concat(F.lit('<a HREF="/x/'), F.replace("spec_id", F.lit("."), F.lit("")), F.lit("-"), "code", F.lit('.zip">v</a> <a href="/x/99999-a00.zip">w</a>'))
    return archives.list_archives(rows.groupBy("spec_id").agg(F.array_join(F.collect_list(link), "\n").alias("html")), "http://a")


@query("s1_archives", f"WITH {LISTED} SELECT spec_id, version_code, a || '.' || b || '.' || c AS version, a AS release, 'http://a/' || split_part(spec_id, '.', 1) || '_series/' || spec_id || '/' || replace(spec_id, '.', '') || '-' || version_code || '.zip' AS url, replace(spec_id, '.', '') || '-' || version_code || '.zip' AS filename FROM digits")
def s1_archives(spark, sf_dir):
    return listing(spark, sf_dir).withColumn("release", F.col("release").cast("long"))


@query("s2_pick", f"WITH {LISTED}, best AS (SELECT 'any' AS asked, spec_id, max(row(a, b, c)) AS v FROM digits GROUP BY spec_id UNION ALL SELECT '16', spec_id, max(row(a, b, c)) FROM digits WHERE a = 16 GROUP BY spec_id) SELECT asked, spec_id, v[1] || '.' || v[2] || '.' || v[3] AS version FROM best")
def s2_pick(spark, sf_dir):
    rows = listing(spark, sf_dir)
    a = archives.pick(rows).select(F.lit("any").alias("asked"), "spec_id", "version")
    return a.unionByName(archives.pick(rows, 16).select(F.lit("16").alias("asked"), "spec_id", "version"))


@query("s5_part_order", f"WITH {CODED} SELECT doc_id, row_number() OVER (PARTITION BY lang ORDER BY coalesce(try_cast(nullif(regexp_extract(lower(name), '-[0-9a-z]{{3}}_(\\d+)_', 1), '') AS INTEGER), 999), lower(name)) AS place FROM (SELECT doc_id, lang, 'x-' || code || '_' || (doc_id % 40) || '_T' || doc_id || '.docx' AS name FROM coded)")
def s5_part_order(spark, sf_dir):
    from pyspark.sql import Window

    name = F.concat(F.lit("x-"), "code", F.lit("_"), (F.col("doc_id") % 40).cast("string"), F.lit("_T"), F.col("doc_id").cast("string"), F.lit(".docx"))
    rows = coded(spark, sf_dir).withColumn("name", name)
    return rows.select("doc_id", F.row_number().over(Window.partitionBy("lang").orderBy(T.part_order("name"))).cast("long").alias("place"))


@query("s17_specs", "SELECT source AS spec_id, 'v' || min_by(doc_id % 7, doc_id) AS version, min_by(doc_id % 5, doc_id) AS release, count(*) AS chunks FROM documents GROUP BY source")
def s17_specs(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    c = d.select(F.col("source").alias("spec_id"), F.col("doc_id").alias("pos"), F.concat(F.lit("v"), (F.col("doc_id") % 7).cast("string")).alias("version"), (F.col("doc_id") % 5).alias("release"))
    return store.specs(c)


@query("s18_clause", "SELECT source AS spec_id, lang AS clause, md5(string_agg(text, chr(10) || chr(10) ORDER BY doc_id)) AS digest FROM documents WHERE source = 'src3' AND lang = 'de' GROUP BY source, lang")
def s18_clause(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    c = d.select(F.col("source").alias("spec_id"), F.col("lang").alias("clause"), F.col("doc_id").alias("part"), "text")
    return store.clause_text(c, "src3", "de").select("spec_id", "clause", F.md5("text").alias("digest"))


@query("f16_normalised", "SELECT doc_id, md5(regexp_replace(lower(text), '\\s+', ' ', 'g')) AS digest FROM documents")
def f16_normalised(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.md5(T.normalised("text")).alias("digest"))


@query("f20_clause_matches", "SELECT doc_id, a, b, a <> '' AND b <> '' AND (a = b OR starts_with(a, b || '.') OR starts_with(b, a || '.')) AS hit FROM (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '' WHEN 1 THEN CAST(doc_id % 6 AS VARCHAR) WHEN 2 THEN (doc_id % 6) || '.' || (doc_id % 3) ELSE chr(65 + CAST(doc_id % 3 AS INTEGER)) || '.' || (doc_id % 5) END AS a, CASE doc_id % 7 WHEN 0 THEN '' WHEN 1 THEN CAST(doc_id % 6 AS VARCHAR) WHEN 2 THEN (doc_id % 6) || '.' || (doc_id % 3) || '.4' WHEN 3 THEN (doc_id % 6) || '' || (doc_id % 3) ELSE chr(65 + CAST(doc_id % 3 AS INTEGER)) END AS b FROM documents)")
def f20_clause_matches(spark, sf_dir):
    d, t = F.col("doc_id"), lambda n: (F.col("doc_id") % n).cast("string")
    letter = F.expr("char(65 + doc_id % 3)")
    a = F.when(d % 4 == 0, "").when(d % 4 == 1, t(6)).when(d % 4 == 2, F.concat(t(6), F.lit("."), t(3))).otherwise(F.concat(letter, F.lit("."), t(5)))
    b = F.when(d % 7 == 0, "").when(d % 7 == 1, t(6)).when(d % 7 == 2, F.concat(t(6), F.lit("."), t(3), F.lit(".4"))).when(d % 7 == 3, F.concat(t(6), t(3))).otherwise(letter)
    return documents(spark, sf_dir).select("doc_id", a.alias("a"), b.alias("b")).withColumn("hit", T.clause_matches("a", "b"))


@query("f14_chunk_sentences", "SELECT doc_id, CAST(len(string_split(regexp_replace(text, '([.;:])\\s+([A-Z0-9(\\[])', '\\1' || chr(30) || '\\2', 'g'), chr(30))) AS BIGINT) AS n FROM documents")
def f14_chunk_sentences(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.size(T.chunk_sentences("text")).cast("long").alias("n"))


# --- pages as blocks: h1 opens a clause, p and li are its paragraphs ---------------------------

TAGGED = r"(?is)<(h1|p|li)\b[^>]*>([^<]*)"
EVENTS = r"""events AS (SELECT page_id, i AS pos, tags[i] AS tag, trim(bodies[i], ' ' || chr(9) || chr(10) || chr(13)) AS text FROM
(SELECT page_id, regexp_extract_all(html, '(?is)<(h1|p|li)\b[^>]*>([^<]*)', 1) AS tags, regexp_extract_all(html, '(?is)<(h1|p|li)\b[^>]*>([^<]*)', 2) AS bodies, unnest(range(1, len(regexp_extract_all(html, '(?is)<(h1|p|li)\b[^>]*>([^<]*)', 1)) + 1)) AS i FROM pages))"""


def page_blocks(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/pages.parquet")
    both = F.arrays_zip(F.regexp_extract_all("html", F.lit(TAGGED), F.lit(1)).alias("tag"), F.regexp_extract_all("html", F.lit(TAGGED), F.lit(2)).alias("body"))
    rows = p.select("page_id", F.posexplode(both).alias("i", "b"))
    style = F.when(F.lower("b.tag") == "h1", "heading 1").when(F.lower("b.tag") == "li", "B1").otherwise("")
    return rows.select(F.col("page_id").cast("string").alias("spec_id"), (F.col("i") + 1).cast("long").alias("pos"), F.lit("p").alias("kind"), style.alias("style"), F.btrim("b.body", F.lit(" \t\n\r")).alias("text"), F.lit(None).cast("array<array<string>>").alias("rows"))


@query("c1_sessions", f"WITH {EVENTS}, numbered AS (SELECT *, sum(CASE WHEN tag = 'h1' THEN 1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY pos) AS clause_no FROM events) SELECT CAST(page_id AS VARCHAR) AS spec_id, pos, CAST(clause_no AS BIGINT) AS clause_no, tag = 'h1' AS opens FROM numbered WHERE clause_no > 0")
def c1_sessions(spark, sf_dir):
    return C.sessionised(page_blocks(spark, sf_dir)).select("spec_id", "pos", F.col("clause_no").cast("long").alias("clause_no"), F.col("level").isNotNull().alias("opens"))


@query("c1_clauses", f"WITH {EVENTS}, numbered AS (SELECT *, sum(CASE WHEN tag = 'h1' THEN 1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY pos) AS clause_no FROM events) SELECT CAST(page_id AS VARCHAR) AS spec_id, count(*) AS paragraphs, CAST(sum(length(regexp_replace(text, ' {{2,}}', ' ', 'g')) + CASE WHEN tag = 'li' THEN 2 ELSE 0 END) AS BIGINT) AS chars FROM numbered WHERE clause_no > 0 AND tag <> 'h1' AND text <> '' GROUP BY page_id, clause_no")
def c1_clauses(spark, sf_dir):
    c = C.clauses(page_blocks(spark, sf_dir))
    return c.select("spec_id", F.size("paragraphs").cast("long").alias("paragraphs"), F.aggregate("paragraphs", F.lit(0).cast("long"), lambda a, p: a + F.length(p)).alias("chars"))


#: Documents as headings of their source, in order of their ids; every eleventh is one that is left out.
HEADED = """headed AS (SELECT source AS spec_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS clause_no, CAST(1 + (doc_id * 7 + doc_id // 3) % 4 AS INTEGER) AS level, CASE WHEN doc_id % 11 = 0 THEN '' ELSE CAST(doc_id AS VARCHAR) END AS number, CASE WHEN doc_id % 11 = 0 THEN 'Foreword' ELSE lang END AS heading FROM documents)"""


@query(
    "c2_ancestry",
    f"""WITH RECURSIVE {HEADED}, fold AS (
SELECT spec_id, clause_no, CAST([] AS VARCHAR[]) AS ancestors, CASE WHEN heading = 'Foreword' THEN CAST([] AS VARCHAR[]) ELSE [trim(number || ' ' || heading)] END AS stack FROM headed WHERE clause_no = 1
UNION ALL SELECT h.spec_id, h.clause_no, f.stack[1:h.level - 1], CASE WHEN h.heading = 'Foreword' THEN f.stack[1:h.level - 1] ELSE list_append(f.stack[1:h.level - 1], trim(h.number || ' ' || h.heading)) END FROM fold f JOIN headed h ON h.spec_id = f.spec_id AND h.clause_no = f.clause_no + 1)
SELECT spec_id, clause_no, array_to_string(ancestors, ' > ') AS trail FROM fold""",
)
def c2_ancestry(spark, sf_dir):
    from pyspark.sql import Window

    d = F.col("doc_id")
    no = F.row_number().over(Window.partitionBy("source").orderBy("doc_id")).cast("long")
    out = d % 11 == 0
    h = documents(spark, sf_dir).select(F.col("source").alias("spec_id"), no.alias("clause_no"), (1 + (d * 7 + F.floor(d / 3)) % 4).cast("int").alias("level"), F.when(out, "").otherwise(d.cast("string")).alias("number"), F.when(out, "Foreword").otherwise(F.col("lang")).alias("heading"))
    return C.ancestry(h).select("spec_id", "clause_no", F.array_join(F.transform("ancestors", lambda a: T.label(a["number"], a["heading"])), " > ").alias("trail"))


#: Documents as blocks of their source: every third opens a clause, some of which are left out or informative.
BLOCKS = """blocks AS (SELECT source AS spec_id, doc_id AS pos, doc_id % 3 = 0 AS opens, CASE WHEN doc_id % 33 = 0 THEN 'Change history' WHEN doc_id % 12 = 0 THEN 'Annex ' || chr(65 + CAST(doc_id % 26 AS INTEGER)) || ' (informative): Notes' WHEN doc_id % 15 = 0 THEN 'Annex Z: Rules' ELSE doc_id || chr(9) || 'Title' END AS head, text FROM documents),
numbered AS (SELECT *, sum(CASE WHEN opens THEN 1 ELSE 0 END) OVER w AS clause_no, coalesce(last_value(CASE WHEN opens AND starts_with(head, 'Annex') THEN NOT contains(head, 'informative') END IGNORE NULLS) OVER w, true) AS normative FROM blocks WINDOW w AS (PARTITION BY spec_id ORDER BY pos ROWS UNBOUNDED PRECEDING))"""


@query(
    "c3_clauses",
    f"""WITH {BLOCKS}, heads AS (SELECT * FROM numbered WHERE opens AND head <> 'Change history'), bodies AS (SELECT spec_id, clause_no, count(*) AS paragraphs FROM numbered WHERE NOT opens AND clause_no > 0 AND trim(text, ' ' || chr(9) || chr(10) || chr(13)) <> '' GROUP BY spec_id, clause_no)
SELECT h.spec_id, CAST(h.clause_no AS BIGINT) AS clause_no, CASE WHEN starts_with(head, 'Annex') THEN substr(head, 7, 1) ELSE CAST(h.pos AS VARCHAR) END AS number, CASE WHEN starts_with(head, 'Annex Z:') THEN 'Rules' WHEN starts_with(head, 'Annex') THEN 'Notes' ELSE 'Title' END AS heading, h.normative, b.paragraphs FROM heads h JOIN bodies b USING (spec_id, clause_no)""",
)
def c3_clauses(spark, sf_dir):
    """Which clauses stay, their numbers and whether they are normative."""
    d = F.col("doc_id")
    head = F.when(d % 33 == 0, "Change history").when(d % 12 == 0, F.expr("concat('Annex ', char(65 + doc_id % 26), ' (informative): Notes')")).when(d % 15 == 0, "Annex Z: Rules").otherwise(F.concat(d.cast("string"), F.lit("\tTitle")))
    opens = d % 3 == 0
    b = documents(spark, sf_dir).select(F.col("source").alias("spec_id"), d.alias("pos"), F.lit("p").alias("kind"), F.when(opens, "Heading1").otherwise("").alias("style"), F.when(opens, head).otherwise(F.col("text")).alias("text"), F.lit(None).cast("array<array<string>>").alias("rows"))
    return C.clauses(b).select("spec_id", F.col("clause_no").cast("long").alias("clause_no"), "number", "heading", "normative", F.size("paragraphs").cast("long").alias("paragraphs"))


def document_clauses(spark, sf_dir):
    """Documents as clauses whose paragraphs are their lines."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    none = F.array().cast("array<string>")
    return d.select(F.col("source").alias("spec_id"), F.col("doc_id").alias("clause_no"), F.col("lang").alias("number"), F.lit("h").alias("heading"), F.lit(1).alias("level"), F.lit(True).alias("normative"), F.array().cast(C.ANCESTORS).alias("ancestors"), F.split("text", "\n").alias("paragraphs"), none.alias("tables"))


@query("c7_whole_or_packed", "SELECT doc_id AS clause_no, CAST(len(regexp_extract_all(array_to_string(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> ''), chr(10) || chr(10)), '[A-Za-z0-9]+(?:[-.''][A-Za-z0-9]+)*')) AS BIGINT) <= 480 AS whole FROM documents WHERE trim(text) <> ''")
def c7_whole_or_packed(spark, sf_dir):
    p = C.pieces(document_clauses(spark, sf_dir))
    return p.select("clause_no", (T.count_tokens(F.array_join(F.filter("paragraphs", lambda b: F.trim(b) != ""), "\n\n")) <= 480).alias("whole"))


#: Packing as a recursion over prefix sums of sizes: groups of sentences of long lines, then pieces of lines.
PACKED = r"""lines AS (SELECT doc_id, source, lang, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS ls FROM documents),
sized AS (SELECT *, array_to_string(ls, chr(10) || chr(10)) AS whole, len(regexp_extract_all(array_to_string(ls, chr(10) || chr(10)), '[A-Za-z0-9]+(?:[-.''][A-Za-z0-9]+)*')) AS n FROM lines WHERE len(ls) > 0),
long_lines AS (SELECT doc_id, i, ls[i] AS line FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM sized WHERE n > 480)),
measured AS (SELECT doc_id, i, line, len(regexp_extract_all(line, '[A-Za-z0-9]+(?:[-.''][A-Za-z0-9]+)*')) AS size FROM long_lines),
sentences AS (SELECT doc_id, i, string_split(regexp_replace(line, '([.;:])\s+([A-Z0-9(\[])', '\1' || chr(30) || '\2', 'g'), chr(30)) AS s FROM measured WHERE size > 480),
summed AS (SELECT doc_id, i, s, list_transform(range(0, len(s) + 1), lambda k: CAST(coalesce(list_sum(list_transform(s[1:k], lambda x: len(regexp_extract_all(x, '[A-Za-z0-9]+(?:[-.''][A-Za-z0-9]+)*')))), 0) AS BIGINT)) AS c FROM sentences),
filled AS (SELECT doc_id, i, s, c, CAST(0 AS BIGINT) AS a, greatest(1, len(list_filter(c, lambda x: x <= 320)) - 1) AS z FROM summed
UNION ALL SELECT doc_id, i, s, c, z, greatest(z + 1, len(list_filter(c, lambda x: x <= c[z + 1] + 320)) - 1) FROM filled WHERE z < len(s)),
units AS (SELECT doc_id, i, CAST(0 AS BIGINT) AS k, line AS unit FROM measured WHERE size <= 480 UNION ALL SELECT doc_id, i, a, array_to_string(s[a + 1 : z], ' ') FROM filled),
lists AS (SELECT doc_id, list(unit ORDER BY i, k) AS u, list(len(regexp_extract_all(unit, '[A-Za-z0-9]+(?:[-.''][A-Za-z0-9]+)*')) ORDER BY i, k) AS sizes FROM units GROUP BY doc_id),
prefixes AS (SELECT doc_id, u, list_transform(range(0, len(u) + 1), lambda k: CAST(coalesce(list_sum(sizes[1:k]), 0) AS BIGINT)) AS c FROM lists),
cut AS (SELECT doc_id, u, c, 0 AS no, CAST(0 AS BIGINT) AS a, greatest(1, len(list_filter(c, lambda x: x <= 320)) - 1) AS z FROM prefixes
UNION ALL SELECT doc_id, u, c, no + 1, a2, greatest(z + 1, len(list_filter(c, lambda x: x <= c[a2 + 1] + 320)) - 1) FROM (SELECT *, greatest(a, len(list_filter(c, lambda x: x < c[z + 1] - 48))) AS a2 FROM cut WHERE z < len(u))),
stripped AS (SELECT doc_id, no, trim(array_to_string(u[a + 1 : z], chr(10) || chr(10)), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS text FROM cut),
pieces AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY no) - 1 AS part, count(*) OVER (PARTITION BY doc_id) AS parts, text FROM stripped WHERE text <> '' UNION ALL SELECT doc_id, 0, 1, trim(whole) FROM sized WHERE n <= 480),
named AS (SELECT p.*, source AS spec_id, source || '#' || lang || '#' || part AS id FROM pieces p JOIN documents USING (doc_id)),
counted AS (SELECT *, row_number() OVER (PARTITION BY spec_id, id ORDER BY doc_id, part) - 1 AS nth FROM named),
chunked AS (SELECT spec_id, doc_id AS clause_no, part, parts, id || CASE WHEN nth > 0 THEN '~' || nth ELSE '' END AS id, text FROM counted)"""


@query(
    "c10_packed_chunks",
    f"""WITH RECURSIVE {PACKED} SELECT spec_id, clause_no, CAST(part AS INTEGER) AS part, CAST(parts AS INTEGER) AS parts, id, CAST(len(regexp_extract_all(text, '[A-Za-z0-9]+(?:[-.''][A-Za-z0-9]+)*')) AS INTEGER) AS tokens, md5(text) AS digest,
lag(id) OVER w AS prev_id, lead(id) OVER w AS next_id FROM chunked WINDOW w AS (PARTITION BY spec_id ORDER BY clause_no, part)""",
)
def c10_packed_chunks(spark, sf_dir):
    c = C.chunks(document_clauses(spark, sf_dir))
    return c.select("spec_id", "clause_no", "part", "parts", "id", "tokens", F.md5("text").alias("digest"), "prev_id", "next_id")


@query(
    "c12_unique_ids",
    """WITH r AS (SELECT source AS spec_id, doc_id AS clause_no, source || '#' || lang AS id, row_number() OVER (PARTITION BY source, source || '#' || lang ORDER BY doc_id) - 1 AS n FROM documents),
u AS (SELECT spec_id, clause_no, id || CASE WHEN n > 0 THEN '~' || n ELSE '' END AS id FROM r) SELECT spec_id, clause_no, id, lag(id) OVER w AS prev_id, lead(id) OVER w AS next_id FROM u WINDOW w AS (PARTITION BY spec_id ORDER BY clause_no)""",
)
def c12_unique_ids(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = d.select(F.col("source").alias("spec_id"), F.col("doc_id").alias("clause_no"), F.concat("source", F.lit("#"), "lang").alias("id"))
    return C.linked(C.unique_ids(rows, order=("clause_no",)), order=("clause_no",))


# --- lexicon: a document is an abbreviation clause whose paragraphs come from its lines ---------

#: Of each line the first three words in small letters, and their initials as acronym; a form of two words for every other line.
MINED = r"""lines AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS ln FROM documents WHERE doc_id % 5 <> 0),
worded AS (SELECT doc_id, source, ln, regexp_extract_all(line, '[a-z]{3,}')[1 : 2 + ln % 2] AS ws FROM lines),
entries AS (SELECT source, doc_id, ln, upper(array_to_string(list_transform(ws, lambda w: w[1]), '')) || CASE WHEN doc_id % 2 = 0 THEN '' ELSE '-' || (doc_id % 3) END AS acronym, array_to_string(ws, ' ') AS expansion FROM worded WHERE len(ws) = 2 + ln % 2 AND len(array_to_string(ws, ' ')) <= 120),
kept AS (SELECT * FROM entries WHERE lower(expansion) <> lower(acronym)),
firsts AS (SELECT acronym, expansion, min(row(source, doc_id, ln)) AS place FROM kept GROUP BY acronym, expansion),
forms AS (SELECT acronym, expansion, place, row_number() OVER (PARTITION BY acronym ORDER BY place) AS ord, min(place) OVER (PARTITION BY acronym) AS origin FROM firsts),
phrases AS (SELECT expansion AS phrase, arg_min(acronym, row(origin, ord)) AS acronym FROM forms GROUP BY expansion)"""


def abbreviations(spark, sf_dir):
    """Clauses of abbreviations; those of every fifth document have another heading, and a line without a tab is no entry."""
    d = F.col("doc_id")

    def line(x, i):
        ws = F.slice(F.regexp_extract_all(x, F.lit("[a-z]{3,}"), F.lit(0)), 1, 2 + (i + 1) % 2)
        acronym = F.concat(F.upper(F.array_join(F.transform(ws, lambda w: F.substring(w, 1, 1)), "")), F.when(d % 2 == 0, "").otherwise(F.concat(F.lit("-"), (d % 3).cast("string"))))
        return F.when(F.size(ws) == 2 + (i + 1) % 2, F.concat(acronym, F.lit("\t"), F.array_join(ws, " "))).otherwise(x)

    heading = F.when(d % 5 == 0, "3.1 Definitions").otherwise("3.2 Abbreviations used")
    return documents(spark, sf_dir).select(F.col("source").alias("spec_id"), d.alias("clause_no"), heading.alias("heading"), F.transform(F.split("text", "\n"), line).alias("paragraphs"))


def mined(spark, sf_dir):
    return C.lexicon(C.entries(abbreviations(spark, sf_dir)))


@query("g3_lexicon", f"WITH {MINED} SELECT acronym, expansion, ord FROM forms")
def g3_lexicon(spark, sf_dir):
    return mined(spark, sf_dir)[0]


@query("g4_reverse", f"WITH {MINED} SELECT phrase, acronym FROM phrases")
def g4_reverse(spark, sf_dir):
    return mined(spark, sf_dir)[1]


@query(
    "g5_expand",
    rf"""WITH {MINED}, asked AS (SELECT item_id AS qid, regexp_extract_all(text, '[A-Za-z0-9]+(?:[-''][A-Za-z0-9]+)*') AS ws FROM benchmark),
single AS (SELECT qid, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM asked),
grams AS (SELECT qid, -n AS b, i AS c, lower(array_to_string(ws[i : i + n - 1], ' ')) AS phrase FROM (SELECT qid, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM asked, (SELECT unnest(range(2, 8)) AS n))),
found AS (SELECT qid, row(0, i, ord) AS place, expansion FROM single s JOIN forms f ON f.acronym = upper(s.w) AND ord <= 2 UNION ALL SELECT qid, row(1, b, c), acronym FROM grams JOIN phrases USING (phrase)),
once AS (SELECT qid, lower(expansion), arg_min(expansion, place) AS expansion, min(place) AS place FROM found GROUP BY qid, lower(expansion))
SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY place) AS ord, expansion FROM once""",
)
def g5_expand(spark, sf_dir):
    return C.expand(questions(spark, sf_dir), *mined(spark, sf_dir))


# --- headings and paragraphs ------------------------------------------------------------------

RAW = """raws AS (SELECT doc_id, lang, source, doc_id % 5 AS k, doc_id % 9 AS n, chr(65 + CAST(doc_id % 26 AS INTEGER)) AS letter FROM documents)"""


@query(
    "f10_headings",
    f"""WITH {RAW} SELECT doc_id, CASE k WHEN 0 THEN (1 + n) || '.' || (doc_id % 7) WHEN 1 THEN letter WHEN 2 THEN '' WHEN 3 THEN letter || '.1' ELSE n || 'A' END AS number,
CASE k WHEN 0 THEN 'Title ' || lang WHEN 1 THEN 'Notes ' || source WHEN 2 THEN 'Foreword ' || lang WHEN 3 THEN source ELSE 'x  y' END AS heading FROM raws""",
)
def f10_headings(spark, sf_dir):
    d, letter = F.col("doc_id"), F.expr("char(65 + doc_id % 26)")
    t = lambda x: x.cast("string")
    raw = (
        F.when(d % 5 == 0, F.concat(t(1 + d % 9), F.lit("."), t(d % 7), F.lit("\tTitle "), "lang"))
        .when(d % 5 == 1, F.concat(F.lit("Annex "), letter, F.lit(" (informative):\tNotes "), "source"))
        .when(d % 5 == 2, F.concat(F.lit("Foreword\t"), "lang"))
        .when(d % 5 == 3, F.concat(letter, F.lit(".1\t"), "source", F.lit("\n")))
        .otherwise(F.concat(F.lit("  "), t(d % 9), F.lit("A\tx  y")))
    )
    return documents(spark, sf_dir).select("doc_id", T.split_heading(raw).alias("h")).select("doc_id", "h.number", "h.heading")


@query("f5_heading_levels", "SELECT doc_id, style, try_cast(nullif(regexp_extract(style, '(?i)^heading\\s*([1-9])$', 1), '') AS INTEGER) AS level FROM (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'Heading' WHEN 1 THEN 'heading ' WHEN 2 THEN 'HEADING  ' ELSE 'TOC' END || (doc_id % 12) AS style FROM documents)")
def f5_heading_levels(spark, sf_dir):
    d = F.col("doc_id")
    style = F.concat(F.when(d % 4 == 0, "Heading").when(d % 4 == 1, "heading ").when(d % 4 == 2, "HEADING  ").otherwise("TOC"), (d % 12).cast("string"))
    return documents(spark, sf_dir).select("doc_id", style.alias("style")).withColumn("level", T.heading_level("style"))


@query("f11_rendered", "SELECT doc_id, 'B' || (1 + doc_id % 5) AS style, md5(repeat('  ', CAST(doc_id % 5 AS INTEGER)) || '- ' || trim(regexp_replace(trim(regexp_replace(text, ' {2,}', ' ', 'g'), ' ' || chr(9) || chr(10) || chr(13)), '^[-\\t ]+', ''), ' ' || chr(9) || chr(10) || chr(13))) AS digest FROM documents WHERE trim(text) <> ''")
def f11_rendered(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("style", F.concat(F.lit("B"), (1 + F.col("doc_id") % 5).cast("string")))
    return d.select("doc_id", "style", F.md5(T.rendered("style", "text")).alias("digest")).where("digest is not null")


#: Documents as tables: a row a line, its first four words and a cell of their number as cells.
CELLS = "cells AS (SELECT doc_id, list_transform(string_split(replace(text, '&', '|'), chr(10)), lambda x: string_split(x, ' ')[1:4]) AS r FROM documents)"


def cells(spark, sf_dir):
    rows = F.transform(F.split(F.replace("text", F.lit("&"), F.lit("|")), "\n"), lambda x: F.slice(F.split(x, " "), 1, 4))
    return documents(spark, sf_dir).select("doc_id", rows.alias("rows"))


@query(
    "f8_markdown",
    rf"""WITH {CELLS}, wide AS (SELECT doc_id, r, list_max(list_transform(r, lambda x: len(x))) AS w FROM cells),
lines AS (SELECT doc_id, w, list_transform(r, lambda x: '| ' || array_to_string(list_concat(list_transform(x, lambda c: trim(replace(c, '|', '\|'))), list_transform(range(w - len(x)), lambda i: '')), ' | ') || ' |') AS l FROM wide)
SELECT doc_id, md5(array_to_string(list_concat(l[1:1], ['|' || array_to_string(list_transform(range(w), lambda i: '---'), '|') || '|'], l[2:]), chr(10))) AS digest FROM lines""",
)
def f8_markdown(spark, sf_dir):
    return cells(spark, sf_dir).select("doc_id", F.md5(T.markdown("rows")).alias("digest"))


@query("f9_table_text", f"WITH {CELLS} SELECT doc_id, md5(array_to_string(list_filter(list_transform(r, lambda x: array_to_string(list_filter(x, lambda c: c <> ''), ' — ')), lambda x: x <> ''), chr(10))) AS digest FROM cells")
def f9_table_text(spark, sf_dir):
    return cells(spark, sf_dir).select("doc_id", F.md5(T.table_text("rows")).alias("digest"))


@query("g7_lookup", "SELECT 'DE' AS acronym, source AS expansion, row_number() OVER (ORDER BY source) AS ord FROM (SELECT DISTINCT source FROM documents WHERE lang = 'de')")
def g7_lookup(spark, sf_dir):
    from pyspark.sql import Window

    rows = documents(spark, sf_dir).select(F.upper("lang").alias("acronym"), F.col("source").alias("expansion")).distinct()
    forms = rows.withColumn("ord", F.row_number().over(Window.partitionBy("acronym").orderBy("expansion")).cast("long"))
    return store.lookup(forms, "de")


@query("c13_links", "SELECT doc_id, lag(CAST(doc_id AS VARCHAR)) OVER w AS prev_id, lead(CAST(doc_id AS VARCHAR)) OVER w AS next_id FROM documents WINDOW w AS (PARTITION BY source ORDER BY lang, doc_id)")
def c13_links(spark, sf_dir):
    d = documents(spark, sf_dir).select("doc_id", F.col("doc_id").cast("string").alias("id"), "source", "lang")
    return C.linked(d, key="source", order=("lang", "doc_id")).select("doc_id", "prev_id", "next_id")


@query("f18_model_prefix", "SELECT doc_id, m AS model, md5(CASE m WHEN 'e5-base' THEN 'query: ' WHEN 'bge-small' THEN 'Represent this sentence for searching relevant passages: ' ELSE '' END || text) AS query, md5(CASE m WHEN 'e5-base' THEN 'passage: ' ELSE '' END || text) AS passage FROM documents, (SELECT unnest(['e5-base', 'bge-small', 'other']) AS m)")
def f18_model_prefix(spark, sf_dir):
    rows = None
    for name in ("e5-base", "bge-small", "other"):
        one = documents(spark, sf_dir).select("doc_id", F.lit(name).alias("model"), F.md5(F.concat(F.lit(T.model_prefix(name, True)), "text")).alias("query"), F.md5(F.concat(F.lit(T.model_prefix(name, False)), "text")).alias("passage"))
        rows = one if rows is None else rows.unionByName(one)
    return rows


@query("f19_sigmoid", "SELECT vec_id, round(1 / (1 + exp(-CAST(embedding[1] AS DOUBLE) * 5)), 6) AS score FROM embeddings")
def f19_sigmoid(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return e.select("vec_id", F.round(T.sigmoid(F.col("embedding")[0].cast("double") * 5), 6).alias("score"))
