"""Building blocks of the SQL equivalents, in DuckDB's dialect."""

from __future__ import annotations

from clauseforge.functions.text import STOPWORDS

STOP = "[" + ", ".join(f"'{w}'" for w in STOPWORDS) + "]"


def tokens(x: str, keep: bool = False) -> str:
    want = (lambda v: "true") if keep else (lambda v: f"NOT list_contains({STOP}, {v})")
    whole = f"list_filter(regexp_extract_all(lower({x}), '[a-z0-9]+(?:[-.][a-z0-9]+)*'), lambda w: {want('w')})"
    parts = f"list_filter(string_split_regex(v, '[-.]'), lambda p: length(p) > 1 AND {want('p')})"
    return f"flatten(list_transform({whole}, lambda v: CASE WHEN regexp_matches(v, '[-.]') THEN list_concat([v], {parts}) ELSE [v] END))"


def sizing(x: str) -> str:
    return f"CAST(len(regexp_extract_all({x}, '[A-Za-z0-9]+(?:[-.''][A-Za-z0-9]+)*')) AS BIGINT)"


CHUNKS = "chunks AS (SELECT doc_id AS pos, source AS spec_id, lang AS clause, text, 'Path: ' || source || ' > ' || lang || chr(10) || chr(10) || text AS indexed FROM documents)"
QUESTIONS = "questions AS (SELECT item_id AS qid, text AS question FROM benchmark)"
POSTINGS = f"""{CHUNKS},
toks AS (SELECT pos, {tokens('indexed')} AS t FROM chunks),
posts AS (SELECT pos, term, count(*) AS tf FROM (SELECT pos, unnest(t) AS term FROM toks) GROUP BY pos, term),
dls AS (SELECT pos, len(t) AS dl FROM toks),
stats AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dls),
terms AS (SELECT term, count(*) AS df, ln(1 + (any_value(n) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM posts, stats GROUP BY term)"""
QUERY = f"""{QUESTIONS},
qall AS (SELECT qid, unnest({tokens('question')}) AS term FROM questions),
qt AS (SELECT qid, term, CAST(count(*) AS DOUBLE) AS w FROM qall GROUP BY qid, term),
qd AS (SELECT qid, list_distinct({tokens('question')}) AS ts FROM questions)"""


def bm25(weights: str = "qt") -> str:
    return f"SELECT q.qid, p.pos, sum(q.w * t.idf * p.tf * 2.4 / (p.tf + 1.4 * (1 - 0.72 + 0.72 * d.dl / s.avgdl))) AS score FROM posts p JOIN {weights} q USING (term) JOIN terms t USING (term) JOIN dls d USING (pos), stats s GROUP BY q.qid, p.pos"


def ranked(scores: str, k: int | None = None) -> str:
    cut = f" WHERE rank <= {k}" if k else ""
    return f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, pos) AS rank FROM {scores}){cut}"


TFIDF = """kept AS (SELECT term, ln((1 + n) / (1 + df)) + 1 AS idf FROM terms, stats WHERE df >= 2 AND df <= n * 0.6),
raww AS (SELECT pos, term, (1 + ln(tf)) * idf AS w FROM posts JOIN kept USING (term)),
docw AS (SELECT pos, term, w / greatest(sqrt(sum(w * w) OVER (PARTITION BY pos)), 1e-9) AS w FROM raww),
rawq AS (SELECT qid, term, (1 + ln(w)) * idf AS v FROM qt JOIN kept USING (term)),
qw AS (SELECT qid, term, v / greatest(sqrt(sum(v * v) OVER (PARTITION BY qid)), 1e-9) AS v FROM rawq),
tf_scores AS (SELECT qid, pos, sum(w * v) AS score FROM docw JOIN qw USING (term) GROUP BY qid, pos)"""
HYBRID = f"""{POSTINGS},
{QUERY},
bm AS ({bm25()}),
bm_top AS ({ranked('(SELECT * FROM bm WHERE score > 0)', 50)}),
{TFIDF},
tf_top AS ({ranked('tf_scores', 50)}),
lists AS (SELECT qid, pos, 1.0 / (60 + rank) AS s, 0 AS l, rank FROM bm_top UNION ALL SELECT qid, pos, 1.0 / (60 + rank), 1, rank FROM tf_top),
fused AS (SELECT qid, pos, CAST(sum(s) AS DOUBLE) AS score, min(l * 1000 + rank) AS first FROM lists GROUP BY qid, pos)"""
TOP20 = f"""{HYBRID},
top20 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, first, pos) AS ord FROM fused) WHERE ord <= 20)"""
#: Rows of top20 with the question's distinct terms, their idf, and the chunk's text.
PAIRS = f"""{TOP20},
qdt AS (SELECT qid, unnest(ts) AS term, ts FROM qd),
pairs AS (SELECT c.qid, c.pos, c.score AS fusion, c.ord, d.term, coalesce(t.idf, 6.0) AS idf, contains(lower(k.indexed), d.term) AS inside, contains(split_part(lower(k.indexed), chr(10) || chr(10), 1), d.term) AS inhead
  FROM top20 c JOIN qdt d USING (qid) JOIN chunks k USING (pos) LEFT JOIN terms t USING (term)),
grams AS (SELECT qid, unnest(list_transform(range(1, greatest(len(ts), 1)), lambda i: ts[i] || ' ' || ts[i + 1])) AS gram, greatest(len(ts) - 1, 1) AS ng FROM (SELECT qid, list(term ORDER BY ix) AS ts FROM (SELECT qid, term, min(ix) AS ix FROM (SELECT qid, unnest(w) AS term, generate_subscripts(w, 1) AS ix FROM (SELECT qid, {tokens('question')} AS w FROM questions)) GROUP BY qid, term) GROUP BY qid)),
gramhits AS (SELECT c.qid, c.pos, sum(CASE WHEN contains(lower(k.indexed), g.gram) THEN 1 ELSE 0 END) / any_value(ng) AS phrase FROM top20 c JOIN grams g USING (qid) JOIN chunks k USING (pos) GROUP BY c.qid, c.pos),
cover AS (SELECT qid, pos, any_value(fusion) AS fusion, any_value(ord) AS ord, sum(CASE WHEN inside THEN idf ELSE 0 END) / sum(idf) AS overlap, sum(CASE WHEN inside AND inhead THEN 1 ELSE 0 END) / count(*) AS heading FROM pairs GROUP BY qid, pos),
reranked AS (SELECT v.qid, v.pos, v.fusion, v.ord, v.overlap, greatest(0.0, least(1.0, 0.62 * v.overlap + 0.18 * coalesce(g.phrase, 0) + 0.20 * v.heading + CASE WHEN length(q.question) > 12 AND contains(lower(k.indexed), lower(q.question)) THEN 0.15 ELSE 0.0 END)) AS score, k.spec_id, k.clause, k.text
  FROM cover v JOIN questions q USING (qid) JOIN chunks k USING (pos) LEFT JOIN gramhits g USING (qid, pos))"""
HITS = f"""{PAIRS},
capped AS (SELECT *, row_number() OVER (PARTITION BY qid, spec_id, clause ORDER BY round(score, 9) DESC, ord, pos) AS nth FROM reranked),
hits AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, ord, pos) AS rank FROM capped WHERE nth <= 2) WHERE rank <= 6)"""
