"""Queries of the gate, contexts, extractive answers, verification and evaluation."""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Window
from pyspark.sql import functions as F

from clauseforge.functions import text as T
from clauseforge.operators import answers as A
from clauseforge.operators import batches
from clauseforge.operators import evaluate as E
from clauseforge.operators import index as I
from clauseforge.operators import retrieval as R
from clauseforge.operators import verify as V
from clauseforge.plans import sql as S
from clauseforge.plans.registry import query
from clauseforge.plans.search import chunks, hits, idf, questions, six
from clauseforge.session import settled

SIGNALS = """sig AS (SELECT q.qid, coalesce(max(h.score) FILTER (WHERE h.rank = 1), 0) AS top, coalesce(avg(h.score) FILTER (WHERE h.rank BETWEEN 2 AND 3), 0) AS support, coalesce(max(h.overlap) FILTER (WHERE h.rank <= 3), 0) AS overlap, count(h.pos) AS hits FROM questions q LEFT JOIN hits h USING (qid) GROUP BY q.qid)"""


@query("q21_signals", f"WITH {S.HITS}, {SIGNALS} SELECT qid, round(top, 6) AS top, round(support, 6) AS support, round(overlap, 6) AS overlap, hits FROM sig")
def q21_signals(spark, sf_dir):
    return A.signals(questions(spark, sf_dir), hits(spark, sf_dir)).select("qid", six("top"), six("support"), six("overlap"), "hits")


@query(
    "a1_gate",
    f"""WITH {S.HITS}, {SIGNALS} SELECT qid, rule = 'sufficient' AS answerable, rule, round(0.60 * top + 0.25 * support + 0.15 * overlap, 3) AS confidence FROM
(SELECT *, CASE WHEN hits = 0 THEN 'retrieval' WHEN top < 0.20 THEN 'best' WHEN overlap < 0.08 THEN 'the' WHEN support < 0.18 AND top < 0.32 THEN 'one' ELSE 'sufficient' END AS rule FROM sig)""",
)
def a1_gate(spark, sf_dir):
    g = A.gate(A.signals(questions(spark, sf_dir), hits(spark, sf_dir)))
    return g.select("qid", "answerable", F.substring_index("reason", " ", 1).alias("rule"), F.round(0.60 * F.col("top") + 0.25 * F.col("support") + 0.15 * F.col("overlap"), 3).alias("confidence"))


def context(spark, sf_dir, found=None):
    found = hits(spark, sf_dir) if found is None else found
    rows = found.join(R.picked(chunks(spark, sf_dir), found, "text", "indexed"), "pos")
    block = F.concat(F.lit("[S"), F.col("rank").cast("string"), F.lit("] "), "indexed")
    return A.within_budget(rows, block)


CONTEXT = f"""{S.HITS},
lengths AS (SELECT h.*, c.text AS body, sum(length('[S' || h.rank || '] ' || c.indexed)) OVER (PARTITION BY h.qid ORDER BY h.rank) AS upto FROM hits h JOIN chunks c USING (pos)),
used AS (SELECT * FROM lengths l WHERE NOT EXISTS (SELECT 1 FROM lengths o WHERE o.qid = l.qid AND o.rank <= l.rank AND o.rank > 1 AND o.upto > 14000))"""


@query("a3_context", f"WITH {CONTEXT} SELECT qid, rank AS n, pos FROM used")
def a3_context(spark, sf_dir):
    return context(spark, sf_dir).select("qid", "n", "pos")


@query("a5_sources", f"WITH {CONTEXT} SELECT qid, rank AS n, round(score, 4) AS score, 'Doc ' || spec_id || ' v1.2.3, clause ' || clause AS citation, 'http://archive/' || spec_id || '_series/' || spec_id || '/' || spec_id || '-123.zip' AS url FROM used")
def a5_sources(spark, sf_dir):
    version = F.lit("1.2.3")
    cite = T.citation("Doc ", F.col("spec_id"), version, F.col("clause"), F.lit(""))
    return context(spark, sf_dir).select("qid", "n", F.round("score", 4).alias("score"), cite.alias("citation"), T.archive_url("http://archive", F.col("spec_id"), version).alias("url"))


def quotes(table: str, key: str, body: str) -> str:
    """SQL rows (key, line, span) of quotable sentences in ``table``."""
    mark = r"regexp_replace(trim(line, ' ' || chr(9) || chr(13)), '([.;])\s+([A-Z0-9(\[])', '\1' || chr(30) || '\2', 'g')"
    flat = r"trim(regexp_replace(span, '\s+', ' ', 'g'), ' -' || chr(9))"
    return f"""SELECT * FROM (SELECT {key}, ln, sn, {flat} AS sentence FROM (SELECT {key}, ln, unnest(string_split({mark}, chr(30))) AS span, generate_subscripts(string_split({mark}, chr(30)), 1) AS sn
FROM (SELECT {key}, unnest(string_split({body}, chr(10))) AS line, generate_subscripts(string_split({body}, chr(10)), 1) AS ln FROM {table}) WHERE NOT starts_with(trim(line, ' ' || chr(9) || chr(13)), '|')))
WHERE length(sentence) BETWEEN 40 AND 400"""


@query("a6_quotable", f"SELECT doc_id, count(*) AS n, md5(string_agg(sentence, '|' ORDER BY ln, sn)) AS digest FROM ({quotes('documents', 'doc_id', 'text')}) GROUP BY doc_id")
def a6_quotable(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", A.quotable(F.col("text")).alias("q"))
    return d.where(F.size("q") > 0).select("doc_id", F.size("q").cast("long").alias("n"), F.md5(F.array_join("q", "|")).alias("digest"))


def lines(spark, sf_dir):
    held = I.tables(chunks(spark, sf_dir))
    return A.extractive(context(spark, sf_dir, hits(spark, sf_dir, held)), R.weighted_terms(questions(spark, sf_dir), held["terms"]))


EXTRACTED = f"""{CONTEXT}, spans AS ({quotes("(SELECT qid, rank AS n, body FROM used WHERE rank <= 3)", "qid, n", "body")}),
qdu AS (SELECT DISTINCT qid, term, coalesce(idf, 6.0) AS idf FROM qdt LEFT JOIN terms USING (term)),
graded AS (SELECT s.qid, s.n, s.ln, s.sn, any_value(s.sentence) AS sentence, sum(CASE WHEN contains(lower(s.sentence), d.term) THEN d.idf ELSE 0 END) AS score FROM spans s JOIN qdu d USING (qid) GROUP BY s.qid, s.n, s.ln, s.sn),
quoted AS (SELECT qid, n, line, sentence || ' [S' || n || ']' AS text FROM (SELECT *, row_number() OVER (PARTITION BY qid, n ORDER BY round(score, 9) DESC, ln, sn) AS line FROM graded) WHERE line <= 2)"""


@query("a7_extractive", f"WITH {EXTRACTED} SELECT qid, n, line, text FROM quoted")
def a7_extractive(spark, sf_dir):
    return lines(spark, sf_dir).select("qid", "n", "line", "text")


ANSWERS = "SELECT conv_id * 1000 + turn AS qid, '- ' || text || ' [S1][S' || (1 + turn % 3) || ']' || chr(10) || '* plain line [S2] ' || chr(10) || 'Limit ' || (conv_id % 3) || '.5 of T30' || (conv_id % 4) || ' in MM IDLE [S1]' AS answer FROM conversations WHERE role = 'assistant'"


def conversation_answers(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet").where("role = 'assistant'")
    answer = F.concat(F.lit("- "), "text", F.lit(" [S1][S"), (1 + F.col("turn") % 3).cast("string"), F.lit("]\n* plain line [S2] \nLimit "), (F.col("conv_id") % 3).cast("string"), F.lit(".5 of T30"), (F.col("conv_id") % 4).cast("string"), F.lit(" in MM IDLE [S1]"))
    return c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("qid"), answer.alias("answer"))


CLAIMS = r"""raws AS (SELECT qid, unnest(string_split(answer, chr(10))) AS raw, generate_subscripts(string_split(answer, chr(10)), 1) - 1 AS ix FROM answers),
stripped AS (SELECT qid, ix, regexp_replace(trim(raw, ' '), '^[-*•]\s*', '') AS raw FROM raws WHERE trim(raw, ' ') <> ''),
claims AS (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY ix) - 1 AS claim_no, trim(regexp_replace(trim(regexp_replace(raw, '(?:\s*\[S\d+\])+\s*$', ''), ' '), '\[S\d+\]', '', 'g'), ' ') AS text, list_sort(list_distinct(list_transform(regexp_extract_all(raw, '\[S(\d+)\]', 1), lambda n: CAST(n AS INTEGER)))) AS citations FROM stripped)"""


@query("v1_claims", f"WITH answers AS ({ANSWERS}), {CLAIMS} SELECT qid, claim_no, text, array_to_string(citations, ',') AS citations FROM claims WHERE text <> ''")
def v1_claims(spark, sf_dir):
    return V.claims(conversation_answers(spark, sf_dir)).select("qid", "claim_no", "text", F.array_join("citations", ",").alias("citations"))


def user_turns(spark, sf_dir):
    """Of each assistant turn the two texts before it, as sources 1 and 2, each with values of its own."""
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    values = F.concat(F.lit(" limit "), (F.col("conv_id") % 2).cast("string"), F.lit(".5 t30"), (F.col("conv_id") % 2).cast("string"), F.lit(" mm idle"))
    c = c.withColumn("text", F.concat("text", values))
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = c.withColumn("a", F.lag("text", 1).over(w)).withColumn("b", F.lag("text", 2).over(w)).where("role = 'assistant'")
    n = F.explode(F.array(F.struct(F.lit(1).alias("n"), F.col("a").alias("text")), F.struct(F.lit(2).alias("n"), F.col("b").alias("text"))))
    return rows.select((F.col("conv_id") * 1000 + F.col("turn")).alias("qid"), n.alias("s")).select("qid", "s.n", "s.text").where("text is not null")


CITED = rf"""merged AS (SELECT c.qid, c.claim_no, any_value(c.text) AS text, string_agg(s.body, ' ' ORDER BY s.n) AS body FROM (SELECT qid, claim_no, text, unnest(citations) AS n FROM claims) c JOIN srcs s USING (qid, n) GROUP BY c.qid, c.claim_no),
cterms AS (SELECT DISTINCT qid, claim_no, body, unnest({S.tokens('text')}) AS term FROM merged)"""
SUPPORT = rf"""turns AS (SELECT conv_id, turn, role, lag(told, 1) OVER w AS a, lag(told, 2) OVER w AS b FROM (SELECT *, text || ' limit ' || (conv_id % 2) || '.5 t30' || (conv_id % 2) || ' mm idle' AS told FROM conversations) WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
srcs AS (SELECT conv_id * 1000 + turn AS qid, 1 AS n, regexp_replace(lower(a), '[\s]+', ' ', 'g') AS body FROM turns WHERE role = 'assistant' AND a IS NOT NULL UNION ALL SELECT conv_id * 1000 + turn, 2, regexp_replace(lower(b), '[\s]+', ' ', 'g') FROM turns WHERE role = 'assistant' AND b IS NOT NULL),
{CITED}"""


@query("v4_support", f"WITH {S.POSTINGS}, answers AS ({ANSWERS}), {CLAIMS}, {SUPPORT} SELECT qid, claim_no, round(sum(CASE WHEN contains(body, term) THEN coalesce(idf, 6.0) ELSE 0 END) / sum(coalesce(idf, 6.0)), 6) AS support FROM cterms LEFT JOIN terms USING (term) GROUP BY qid, claim_no")
def v4_support(spark, sf_dir):
    parsed = V.claims(conversation_answers(spark, sf_dir))
    v = V.verified(parsed, user_turns(spark, sf_dir), idf(spark, sf_dir)).join(parsed.select("qid", "claim_no", F.size(F.array_distinct(T.tokens("text"))).alias("k")), ["qid", "claim_no"])
    return v.where((F.col("k") > 0) & (F.size("citations") > 0)).select("qid", "claim_no", six("support"))


#: The patterns without a look-around, in plain ASCII; numbers alone are left to the tests.
HARD_SQL = ", ".join(f"regexp_extract_all(t, '{p}')" for p in (r"(?i)\b(?:TS|TR)\s?\d{2}\.\d{3}\b", r"\bT\d{3,4}[A-Za-z]?\b", r"\b0x[0-9A-Fa-f]+\b", r"\b[A-Z][A-Z0-9-]{2,}(?:\s+[A-Z][A-Z0-9-]{2,})+\b"))


@query(
    "v2_hard_tokens",
    rf"""WITH source AS (SELECT doc_id, 'See ts 24.' || (100 + doc_id % 7) || ', T3' || (doc_id % 300) || 'x, 0xA' || doc_id || ' and MM IDLE-' || doc_id || ' or UE, ABC/D' || doc_id || ' NAS. ' || upper(substr(regexp_replace(text, '[^ -~]', 'x', 'g'), 1, 90)) AS t FROM documents),
found AS (SELECT doc_id, flatten([{HARD_SQL}, list_filter(regexp_extract_all(t, '\b[A-Z][A-Z0-9]{{2,}}(?:[-/][A-Z0-9]+)*\b'), lambda w: NOT list_contains({list(V.AMBIENT)}, w))]) AS l FROM source),
keyed AS (SELECT doc_id, l, list_transform(l, lambda w: regexp_replace(lower(w), '\s+', ' ', 'g')) AS k FROM found)
SELECT doc_id, array_to_string(list_filter(l, lambda w, i: list_position(k, k[i]) = i), '|') AS hard FROM keyed""",
)
def v2_hard_tokens(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    n = F.col("doc_id").cast("string")
    made = F.concat(F.lit("See ts 24."), (100 + F.col("doc_id") % 7).cast("string"), F.lit(", T3"), (F.col("doc_id") % 300).cast("string"), F.lit("x, 0xA"), n, F.lit(" and MM IDLE-"), n, F.lit(" or UE, ABC/D"), n, F.lit(" NAS. "))
    # The pattern takes one character for another, so only those that are kept are looked at.
    text = F.concat(made, F.upper(F.regexp_replace(F.substring("text", 1, 90), "[^ -~]", "x")))
    return d.select("doc_id", F.array_join(F.filter(V.hard_tokens(text), lambda t: t.rlike("[A-Za-z]")), "|").alias("hard"))


#: A number stands at the start of a run of word characters and dots, and ends before a dot or with the run.
NUMBERS_SQL = r"list_filter(list_transform(regexp_extract_all(t, '[\p{L}\p{M}\p{Nd}\p{Pc}.]+'), lambda r: regexp_extract(r, '^(\d+(?:\.\d+)*)(?:\.|$)', 1)), lambda r: r <> '')"
VERDICTS = rf"""shares AS (SELECT qid, claim_no, sum(CASE WHEN contains(body, term) THEN coalesce(idf, 6.0) ELSE 0 END) / sum(coalesce(idf, 6.0)) AS support FROM cterms LEFT JOIN terms USING (term) GROUP BY qid, claim_no),
held AS (SELECT qid, claim_no, body, text AS t, {S.tokens('body', True)} AS ts FROM merged),
listed AS (SELECT *, flatten([{HARD_SQL}, list_filter(regexp_extract_all(t, '\b[A-Z][A-Z0-9]{{2,}}(?:[-/][A-Z0-9]+)*\b'), lambda w: NOT list_contains({list(V.AMBIENT)}, w)), {NUMBERS_SQL}]) AS l FROM held),
keys AS (SELECT *, list_transform(l, lambda w: regexp_replace(lower(w), '\s+', ' ', 'g')) AS k FROM listed),
missed AS (SELECT qid, claim_no, list_filter(l, lambda w, i: list_position(k, k[i]) = i AND NOT CASE WHEN contains(k[i], ' ') THEN contains(body, k[i]) ELSE list_contains(ts, k[i]) OR contains(replace(body, ' ', ''), k[i]) END) AS bad FROM keys),
verdicts AS (SELECT c.qid, c.claim_no, c.text, CASE WHEN m.qid IS NULL THEN 0.0 ELSE coalesce(s.support, 0.0) END AS support, coalesce(array_to_string(m.bad, ','), '') AS ungrounded,
  CASE WHEN m.qid IS NULL THEN 'no valid citation' WHEN len(m.bad) > 0 THEN 'not in the cited passage: ' || array_to_string(m.bad[1:5], ', ') WHEN round(coalesce(s.support, 0.0), 9) < 0.45 THEN 'weak support ' ELSE 'grounded' END AS reason
  FROM claims c LEFT JOIN missed m USING (qid, claim_no) LEFT JOIN shares s USING (qid, claim_no) WHERE c.text <> '')"""


def verdicts(spark, sf_dir):
    return V.verified(V.claims(conversation_answers(spark, sf_dir)), user_turns(spark, sf_dir), idf(spark, sf_dir))


@query("v5_verify", f"WITH {S.POSTINGS}, answers AS ({ANSWERS}), {CLAIMS}, {SUPPORT}, {VERDICTS} SELECT qid, claim_no, reason = 'grounded' AS supported, round(support, 6) AS support, ungrounded, reason FROM verdicts")
def v5_verify(spark, sf_dir):
    """Verdicts on the assistant's turns against the two texts before them; a reason without its figure."""
    reason = F.substring_index("reason", "(", 1).alias("reason")
    return verdicts(spark, sf_dir).select("qid", "claim_no", "supported", six("support"), F.array_join("ungrounded", ",").alias("ungrounded"), reason)


@query(
    "a10_answers",
    rf"""WITH {EXTRACTED}, {SIGNALS}, answers AS (SELECT qid, string_agg(text, chr(10) ORDER BY n, line) AS answer FROM quoted GROUP BY qid), {CLAIMS},
srcs AS (SELECT qid, rank AS n, regexp_replace(lower(indexed), '\s+', ' ', 'g') AS body FROM used JOIN chunks USING (pos)), {CITED}, {VERDICTS},
gates AS (SELECT qid, CASE WHEN hits = 0 THEN 'retrieval' WHEN top < 0.20 THEN 'best' WHEN overlap < 0.08 THEN 'the' WHEN support < 0.18 AND top < 0.32 THEN 'one' ELSE 'sufficient' END AS rule FROM sig),
marked AS (SELECT v.qid, v.claim_no, v.reason = 'grounded' AS good, v.text || ' ' || array_to_string(list_transform(list_filter(c.citations, lambda n: list_contains(o.offered, n)), lambda n: '[S' || n || ']'), '') AS line FROM verdicts v JOIN claims c USING (qid, claim_no) JOIN (SELECT qid, list(n) AS offered FROM srcs GROUP BY qid) o USING (qid)),
counted AS (SELECT qid, count(*) AS claims, count(*) FILTER (WHERE good) AS kept, string_agg(line, chr(10) ORDER BY claim_no) FILTER (WHERE good) AS shown FROM marked GROUP BY qid),
decided AS (SELECT g.qid, rule, rule = 'sufficient' AND coalesce(kept, 0) > 0 AS good, coalesce(claims, 0) AS claims, coalesce(kept, 0) AS kept, shown FROM gates g LEFT JOIN counted USING (qid))
SELECT qid, md5(CASE WHEN good THEN shown ELSE '{A.REFUSAL}' END) AS digest, NOT good AS abstained, CASE WHEN rule <> 'sufficient' OR good THEN rule ELSE 'no' END AS rule, CASE WHEN good THEN round(kept / claims, 4) ELSE 0.0 END AS groundedness, kept, claims FROM decided""",
)
def a10_answers(spark, sf_dir):
    """Gate, extractive lines, claims, verification and assembly for every benchmark question."""
    held = I.tables(chunks(spark, sf_dir))
    q, h, weights = questions(spark, sf_dir), hits(spark, sf_dir, held), held["terms"]
    used = settled(context(spark, sf_dir, h))
    raw = A.extractive(used, R.weighted_terms(q, weights)).groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "line", "text"))), lambda x: x["text"]), "\n").alias("answer"))
    found = V.verified(settled(V.claims(raw)), used.select("qid", "n", F.col("indexed").alias("text")), weights)
    out = A.assembled(q, A.gate(A.signals(q, h)), settled(found))
    return out.select("qid", F.md5("answer").alias("digest"), "abstained", F.substring_index("reason", " ", 1).alias("rule"), "groundedness", "kept", "claims")


@query(
    "v6_groundedness",
    f"WITH {S.POSTINGS}, answers AS ({ANSWERS}), {CLAIMS}, {SUPPORT}, {VERDICTS} SELECT a.qid, count(v.qid) AS claims, CAST(coalesce(sum(CASE WHEN reason = 'grounded' THEN 1 ELSE 0 END), 0) AS BIGINT) AS kept, round(coalesce(avg(CASE WHEN reason = 'grounded' THEN 1.0 ELSE 0.0 END), 0), 6) AS groundedness FROM answers a LEFT JOIN verdicts v USING (qid) GROUP BY a.qid",
)
def v6_groundedness(spark, sf_dir):
    return V.groundedness(verdicts(spark, sf_dir), conversation_answers(spark, sf_dir)).select("qid", "claims", "kept", six("groundedness"))


# --- evaluation on passages that the documents hold verbatim ----------------------------------


def expected(spark, sf_dir, held):
    """Benchmark items found verbatim in documents: the specification and clause of each such document.

    A document that holds a question holds its inner words whole, and so their tokens; only documents with
    the token of them that fewest have, as the index ``held`` lists them, are searched.
    """
    q = questions(spark, sf_dir).withColumn("words", F.split("question", r"\s+"))
    inner = F.when(F.size("words") > 2, F.slice("words", 2, F.size("words") - 2)).otherwise(F.array().cast("array<string>"))
    asked = settled(q.select("qid", F.explode(F.array_distinct(T.tokens(F.array_join(inner, " ")))).alias("term")))
    known = held["terms"].select("term", "df").join(R.sized(asked.select("term").distinct()), "term", "left_semi")
    rarity = asked.join(known, "term", "left").fillna(0, ["df"])
    key = settled(rarity.groupBy("qid").agg(F.min_by("term", F.struct("df", "term")).alias("term")))
    rare = key.select("term").distinct().toArrow()["term"].combine_chunks()
    pairs = settled(batches.having(held["batches"], rare).join(F.broadcast(key), "term").select("qid", "pos"))  # of a question as many as have its rarest token
    c, q = chunks(spark, sf_dir).select("pos", "spec_id", "clause", "text", "indexed"), q.select("qid", "question")
    rows = pairs.join(q, "qid").join(R.picked(c, pairs, "spec_id", "clause", "text"), "pos")
    # Searched everywhere: questions without an inner token; for all questions: documents that the index has no text of.
    short = R.sized(q.join(key, "qid", "left_anti")).join(c.where("indexed is not null"))
    bare = R.sized(q).join(c.where("indexed is null"))
    for more in (short, bare):
        rows = rows.select("qid", "question", "spec_id", "clause", "text").unionByName(more.select("qid", "question", "spec_id", "clause", "text"))
    return rows.where(F.col("text").contains(F.col("question"))).select("qid", "spec_id", "clause").distinct()


TRUTH = "expected AS (SELECT DISTINCT q.qid, c.spec_id, c.clause FROM questions q JOIN chunks c ON contains(c.text, q.question))"


@query("e1_rank_of", f"WITH {S.HITS}, {TRUTH} SELECT e.qid, min(h.rank) AS hit_rank FROM expected e LEFT JOIN hits h ON h.qid = e.qid AND h.spec_id = e.spec_id AND h.clause = e.clause GROUP BY e.qid")
def e1_rank_of(spark, sf_dir):
    held = I.tables(chunks(spark, sf_dir))
    return E.rank_of(hits(spark, sf_dir, held), expected(spark, sf_dir, held))


def mode_hits(name: str, top: str) -> str:
    return f"""SELECT '{name}' AS mode, qid, spec_id, clause, row_number() OVER (PARTITION BY qid ORDER BY place) AS rank FROM
(SELECT t.qid, c.spec_id, c.clause, t.place, row_number() OVER (PARTITION BY t.qid, c.spec_id, c.clause ORDER BY t.place) AS nth FROM ({top}) t JOIN chunks c USING (pos)) WHERE nth <= 2 QUALIFY row_number() OVER (PARTITION BY qid ORDER BY place) <= 6"""


@query(
    "e2_ablation",
    f"""WITH {S.HITS}, {TRUTH}, runs AS ({mode_hits('bm25', 'SELECT qid, pos, rank AS place FROM bm_top WHERE rank <= 20')} UNION ALL {mode_hits('dense', 'SELECT qid, pos, rank AS place FROM tf_top WHERE rank <= 20')} UNION ALL {mode_hits('hybrid', 'SELECT qid, pos, ord AS place FROM top20')} UNION ALL SELECT 'hybrid+rerank', qid, spec_id, clause, rank FROM hits),
ranks AS (SELECT m.mode, e.qid, min(r.rank) AS hit_rank FROM (SELECT DISTINCT mode FROM runs) m CROSS JOIN expected e LEFT JOIN runs r ON r.mode = m.mode AND r.qid = e.qid AND r.spec_id = e.spec_id AND r.clause = e.clause GROUP BY m.mode, e.qid)
SELECT mode, count(*) AS questions, round(count(hit_rank) / count(*), 4) AS recall, round(coalesce(sum(1.0 / hit_rank), 0) / count(*), 4) AS mrr, round(count(*) FILTER (WHERE hit_rank = 1) / count(*), 4) AS top1, median(hit_rank) AS median_rank FROM ranks GROUP BY mode""",
)
def e2_ablation(spark, sf_dir):
    held, q = I.tables(chunks(spark, sf_dir)), questions(spark, sf_dir)
    truth = settled(expected(spark, sf_dir, held))
    second, rows = settled(R.tfidf_search(held["chunks"], q, 50, tables=held)), None
    for mode, rerank in (("bm25", False), ("dense", False), ("hybrid", False), ("hybrid", True)):
        name = mode + "+rerank" * rerank
        one = E.rank_of(R.retrieve(held["chunks"], q, held["terms"], mode=mode, rerank=rerank, second=second, tables=held), truth).withColumn("mode", F.lit(name))
        rows = one if rows is None else rows.unionByName(one)
    return E.retrieval_metrics(rows)


ITEMS = """items AS (SELECT l.doc_id AS qid, l.quality = 1 AS expect_answerable, l.toxic = 1 AS abstained, (l.doc_id % 5) / 4.0 AS groundedness, l.doc_id % 4 AS claims, l.doc_id % 2 AS dropped, CASE WHEN l.doc_id % 3 = 0 THEN NULL ELSE 1 + l.doc_id % 3 END AS hit_rank, l.doc_id % 7 <> 0 AS has_truth FROM labels l)"""


@query(
    "e5_summary",
    f"""WITH {ITEMS} SELECT count(*) AS questions, count(*) FILTER (WHERE expect_answerable) AS answerable, count(*) FILTER (WHERE NOT expect_answerable) AS adversarial,
round(avg(CASE WHEN abstained THEN 0.0 ELSE 1.0 END) FILTER (WHERE expect_answerable), 4) AS answer_rate, round(avg(CASE WHEN abstained THEN 1.0 ELSE 0.0 END) FILTER (WHERE NOT expect_answerable), 4) AS correct_abstention_rate,
count(*) FILTER (WHERE NOT expect_answerable AND NOT abstained) AS false_answers, round(avg(CASE WHEN hit_rank IS NULL THEN 0.0 ELSE 1.0 END) FILTER (WHERE expect_answerable AND has_truth), 4) AS retrieval_recall,
round(avg(coalesce(1.0 / hit_rank, 0.0)) FILTER (WHERE expect_answerable AND has_truth), 4) AS mrr, round(avg(groundedness) FILTER (WHERE expect_answerable AND NOT abstained), 4) AS mean_groundedness,
CAST(sum(claims) FILTER (WHERE expect_answerable AND NOT abstained) AS BIGINT) AS claims_emitted, CAST(sum(dropped) FILTER (WHERE expect_answerable AND NOT abstained) AS BIGINT) AS claims_rejected FROM items""",
)
def e5_summary(spark, sf_dir):
    d = F.col("doc_id")
    rank = F.when(d % 3 != 0, 1 + d % 3)
    items = spark.read.parquet(f"{sf_dir}/labels.parquet").select((F.col("quality") == 1).alias("expect_answerable"), (F.col("toxic") == 1).alias("abstained"), F.lit(True).alias("correct_decision"), ((d % 5) / 4.0).alias("groundedness"), (d % 4).alias("claims"), (d % 2).alias("dropped"), rank.alias("hit_rank"), (d % 7 != 0).alias("has_truth"))
    return E.summary(items)


CHECKED = """golden AS (SELECT doc_id AS qid, doc_id % 4 <> 0 AS expect_answerable, [translate(substr(text, 1, 5), 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ'), 'zz' || doc_id] AS must_include, [lang || ' ', substr(text, 8, 4)] AS must_not_include FROM documents),
given AS (SELECT doc_id AS qid, text AS answer, doc_id % 5 = 0 AS abstained, doc_id % 3 AS offered, CASE WHEN doc_id % 2 = 0 THEN [1, 2] ELSE CAST([] AS INTEGER[]) END AS cited FROM documents)"""


@query(
    "e3_item_checks",
    f"""WITH {CHECKED} SELECT qid, expect_answerable, abstained, abstained <> expect_answerable AS correct_decision,
array_to_string(CASE WHEN abstained THEN CAST([] AS VARCHAR[]) ELSE list_filter(must_include, lambda x: NOT contains(lower(answer), lower(x))) END, '|') AS missing, array_to_string(list_filter(must_not_include, lambda x: contains(lower(answer), lower(x))), '|') AS forbidden, len(list_filter(cited, lambda n: n < 1 OR n > offered)) = 0 AS citations_valid FROM golden JOIN given USING (qid)""",
)
def e3_item_checks(spark, sf_dir):
    d, n = spark.read.parquet(f"{sf_dir}/documents.parquet"), F.col("doc_id")
    golden = d.select(n.alias("qid"), (n % 4 != 0).alias("expect_answerable"), F.array(F.translate(F.substring("text", 1, 5), ascii_lowercase, ascii_uppercase), F.concat(F.lit("zz"), n.cast("string"))).alias("must_include"), F.array(F.concat("lang", F.lit(" ")), F.substring("text", 8, 4)).alias("must_not_include"))
    given = d.select(n.alias("qid"), F.col("text").alias("answer"), (n % 5 == 0).alias("abstained"), (n % 3).alias("offered"), F.when(n % 2 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array().cast("array<int>")).alias("cited"))
    rows = E.item_checks(given, golden)
    return rows.select("qid", "expect_answerable", "abstained", "correct_decision", F.array_join("missing_required", "|").alias("missing"), F.array_join("forbidden_present", "|").alias("forbidden"), "citations_valid")
