"""Queries of tokens, index tables, search, fusion and ranking."""

from __future__ import annotations

from pyspark.sql import functions as F

from clauseforge.functions import text as T
from clauseforge.operators import index as I
from clauseforge.operators import retrieval as R
from clauseforge.plans import sql as S
from clauseforge.plans.registry import query
from clauseforge.session import settled


def chunks(spark, sf_dir):
    """Documents as chunks: source as specification, language as clause."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    header = F.concat(F.lit("Path: "), "source", F.lit(" > "), "lang", F.lit("\n\n"))
    return d.select(F.col("doc_id").alias("pos"), F.col("source").alias("spec_id"), F.col("lang").alias("clause"), "text", F.concat(header, "text").alias("indexed"), F.lit(1).alias("parts"))


def questions(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("qid"), F.col("text").alias("question"))


def idf(spark, sf_dir):
    c = chunks(spark, sf_dir)
    return I.tables(c)["terms"]


def six(name: str):
    return F.round(name, 6).alias(name)


@query("f13_tokens", f"SELECT doc_id, CAST(len(t) AS BIGINT) AS n_tokens, CAST(len(list_distinct(t)) AS BIGINT) AS n_distinct, md5(array_to_string(t, ' ')) AS digest FROM (SELECT doc_id, {S.tokens('text')} AS t FROM documents)")
def f13_tokens(spark, sf_dir):
    t = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", T.tokens("text").alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.size(F.array_distinct("t")).cast("long").alias("n_distinct"), F.md5(F.array_join("t", " ")).alias("digest"))


@query("f12_sizing_tokens", f"SELECT doc_id, {S.sizing('text')} AS n_tokens, {S.sizing('text')} > 480 AS oversized FROM documents")
def f12_sizing_tokens(spark, sf_dir):
    n = T.count_tokens("text").cast("long")
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", n.alias("n_tokens"), (n > 480).alias("oversized"))


@query("i1_term_frequencies", f"WITH {S.POSTINGS} SELECT pos, term, tf FROM posts")
def i1_term_frequencies(spark, sf_dir):
    return I.postings(chunks(spark, sf_dir)).select("pos", "term", "tf")


@query("i2_corpus_stats", f"WITH {S.POSTINGS} SELECT n, round(avgdl, 6) AS avgdl FROM stats")
def i2_corpus_stats(spark, sf_dir):
    return I.corpus_stats(chunks(spark, sf_dir)).select("n", six("avgdl"))


@query("i3_term_stats", f"WITH {S.POSTINGS} SELECT term, df, round(idf, 6) AS idf FROM terms")
def i3_term_stats(spark, sf_dir):
    return idf(spark, sf_dir).select("term", "df", six("idf"))


@query("i6_tfidf", f"WITH {S.POSTINGS}, {S.QUERY}, {S.TFIDF} SELECT pos, term, round(w, 6) AS w FROM docw")
def i6_tfidf(spark, sf_dir):
    return I.tables(chunks(spark, sf_dir))["weights"].select("pos", "term", six("w"))


@query(
    "i7_latent_vectors",
    f"""WITH {S.POSTINGS}, {S.QUERY}, {S.TFIDF}, held AS (SELECT pos, min(pos) OVER (PARTITION BY indexed) AS first FROM chunks SEMI JOIN docw USING (pos)),
shape AS (SELECT least(256, greatest(2, least((SELECT count(*) FROM held), (SELECT count(*) FROM kept)) - 1)) AS dims)
SELECT pos, first, dims, CAST(1 AS DOUBLE) AS length, CAST(1 AS DOUBLE) AS cosine_with_first FROM held, shape""",
)
def i7_latent_vectors(spark, sf_dir):
    """What holds of latent vectors: their number of dimensions, unit length, and that equal texts have equal vectors."""
    c = chunks(spark, sf_dir)
    tables = I.tables(c)
    vectors, _ = I.latent_vectors(tables["weights"], terms=tables["kept"], weighed=tables["weighed"])
    held = vectors.join(c.select("pos", F.sha2("indexed", 256).alias("key")), "pos")
    # Of each text the vector of its first chunk; a text with many copies is summed before it is joined.
    firsts = held.groupBy("key").agg(F.min_by(F.struct("pos", "vector"), "pos").alias("a")).select("key", F.col("a.pos").alias("first"), F.col("a.vector").alias("other"))
    dot = lambda a, b: F.round(F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda t, x: t + x), 4)
    rows = held.join(firsts, "key")
    return rows.select("pos", "first", F.size("vector").cast("long").alias("dims"), dot("vector", "vector").alias("length"), dot("vector", "other").alias("cosine_with_first"))


@query("q1_bm25_scores", f"WITH {S.POSTINGS}, {S.QUERY}, bm AS ({S.bm25()}) SELECT qid, count(*) AS n, round(max(score), 6) AS best, round(sum(score), 4) AS total FROM bm GROUP BY qid")
def q1_bm25_scores(spark, sf_dir):
    s = R.bm25_scores(chunks(spark, sf_dir), R.query_terms(questions(spark, sf_dir)))
    return s.groupBy("qid").agg(F.count("*").alias("n"), F.round(F.max("score"), 6).alias("best"), F.round(F.sum("score"), 4).alias("total"))


@query("q2_bm25_search", f"WITH {S.POSTINGS}, {S.QUERY}, bm AS ({S.bm25()}), top AS ({S.ranked('(SELECT * FROM bm WHERE score > 0)', 5)}) SELECT qid, rank, pos, round(score, 6) AS score FROM top")
def q2_bm25_search(spark, sf_dir):
    return R.bm25_search(chunks(spark, sf_dir), questions(spark, sf_dir), 5).select("qid", "rank", "pos", six("score"))


EXPAND = "SELECT item_id AS qid, 'licence source' AS expansion FROM benchmark WHERE item_id % 2 = 0 UNION ALL SELECT item_id, 'apache-2.0 license' FROM benchmark WHERE item_id % 3 = 0"


@query(
    "q2_bm25_expanded",
    f"""WITH {S.POSTINGS}, {S.QUERY}, ex AS ({EXPAND}), qx AS (SELECT qid, term, sum(w) AS w FROM (SELECT qid, term, w FROM qt UNION ALL SELECT qid, unnest({S.tokens('expansion')}) AS term, 0.45 AS w FROM ex) GROUP BY qid, term),
bm AS ({S.bm25('qx')}), top AS ({S.ranked('bm', 5)}) SELECT qid, rank, pos, round(score, 6) AS score FROM top""",
)
def q2_bm25_expanded(spark, sf_dir):
    q = questions(spark, sf_dir)
    a = q.where("qid % 2 = 0").select("qid", F.lit("licence source").alias("expansion"))
    b = q.where("qid % 3 = 0").select("qid", F.lit("apache-2.0 license").alias("expansion"))
    return R.bm25_search(chunks(spark, sf_dir), q, 5, a.unionByName(b)).select("qid", "rank", "pos", six("score"))


@query(
    "q3_dense_search",
    "WITH q AS (SELECT vec_id AS qid, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings WHERE vec_id % 20 = 0), "
    "s AS (SELECT qid, vec_id AS pos, list_inner_product(v, list_transform(embedding, lambda x: CAST(x AS DOUBLE))) AS score FROM q, embeddings) "
    f"SELECT qid, rank, pos, round(score, 6) AS score FROM ({S.ranked('s', 10)})",
)
def q3_dense_search(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("pos"), F.col("embedding").cast("array<double>").alias("vector"))
    q = e.where("pos % 20 = 0").select(F.col("pos").alias("qid"), "vector")
    return R.dense_search(e, q, 10).select("qid", "rank", "pos", six("score"))


@query("f17_unit_vectors", "SELECT vec_id, round(list_sum(v) / greatest(sqrt(list_inner_product(v, v)), 1e-9), 5) AS total FROM (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE) * 3) AS v FROM embeddings)")
def f17_unit_vectors(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    v = T.unit(F.transform("embedding", lambda x: x.cast("double") * 3))
    return e.select("vec_id", F.round(F.aggregate(v, F.lit(0.0), lambda a, x: a + x), 5).alias("total"))


@query("i6_tfidf_search", f"WITH {S.POSTINGS}, {S.QUERY}, {S.TFIDF}, top AS ({S.ranked('tf_scores', 5)}) SELECT qid, rank, pos, round(score, 6) AS score FROM top")
def i6_tfidf_search(spark, sf_dir):
    return R.tfidf_search(chunks(spark, sf_dir), questions(spark, sf_dir), 5).select("qid", "rank", "pos", six("score"))


def hybrid(spark, sf_dir, held=None):
    c, q = chunks(spark, sf_dir), questions(spark, sf_dir)
    held = held or I.tables(c)
    return R.rrf([(R.bm25_search(c, q, 50, tables=held), 1.0), (R.tfidf_search(c, q, 50, tables=held), 1.0)])


@query("q6_rrf", f"WITH {S.HYBRID} SELECT qid, pos, round(score, 8) AS score FROM fused")
def q6_rrf(spark, sf_dir):
    return hybrid(spark, sf_dir).select("qid", "pos", F.round("score", 8).alias("score"))


@query("q7_top_n", f"WITH {S.TOP20} SELECT qid, pos, ord AS rank, round(score, 8) AS score FROM top20")
def q7_top_n(spark, sf_dir):
    return R.top_n(hybrid(spark, sf_dir), 20).select("qid", "pos", "rank", F.round("score", 8).alias("score"))


@query("q8_spec_boost", f"WITH {S.HYBRID} SELECT f.qid, f.pos, round(f.score * CASE WHEN c.spec_id = 'src' || (f.qid % 20) THEN 1.55 ELSE 1.0 END, 8) AS score FROM fused f JOIN chunks c USING (pos)")
def q8_spec_boost(spark, sf_dir):
    named = questions(spark, sf_dir).select("qid", F.concat(F.lit("src"), (F.col("qid") % 20).cast("string")).alias("spec_id"))
    return R.boost_specs(hybrid(spark, sf_dir), chunks(spark, sf_dir), named).select("qid", "pos", F.round("score", 8).alias("score"))


@query(
    "q9_pins",
    f"""WITH {S.HYBRID}, pinned AS (SELECT qid, pos FROM (SELECT q.qid, c.pos, row_number() OVER (PARTITION BY q.qid ORDER BY c.pos) AS n FROM questions q JOIN chunks c ON c.clause = 'de' AND c.spec_id = 'src' || (q.qid % 20) WHERE q.qid % 2 = 0) WHERE n <= 8)
SELECT qid, pos, round(CAST(sum(score) AS DOUBLE), 8) AS score, bool_or(p) AS pinned FROM (SELECT qid, pos, score, false AS p FROM fused UNION ALL SELECT qid, pos, CAST(1.6 AS DOUBLE) / 61, true FROM pinned) GROUP BY qid, pos""",
)
def q9_pins(spark, sf_dir):
    named = questions(spark, sf_dir).where("qid % 2 = 0").select("qid", F.lit("de").alias("clause"), F.concat(F.lit("src"), (F.col("qid") % 20).cast("string")).alias("spec_hint"))
    rows = R.add_pins(hybrid(spark, sf_dir), R.pins(chunks(spark, sf_dir), named))
    return rows.select("qid", "pos", F.round("score", 8).alias("score"), "pinned")


@query("q10_spec_filter", f"WITH {S.HYBRID} SELECT f.qid, f.pos, round(f.score, 8) AS score FROM fused f JOIN chunks c USING (pos) WHERE f.qid % 2 = 1 OR c.spec_id = 'src' || (f.qid % 20)")
def q10_spec_filter(spark, sf_dir):
    wanted = questions(spark, sf_dir).where("qid % 2 = 0").select("qid", F.concat(F.lit("src"), (F.col("qid") % 20).cast("string")).alias("spec_id"))
    return R.keep_specs(hybrid(spark, sf_dir), chunks(spark, sf_dir), wanted).select("qid", "pos", F.round("score", 8).alias("score"))


@query(
    "q11_siblings",
    f"""WITH {S.TOP20}, parted AS (SELECT doc_id AS pos, source AS spec_id, CAST(doc_id // 3 AS VARCHAR) AS clause FROM documents)
SELECT DISTINCT t.qid, n.pos FROM top20 t JOIN parted c ON c.pos = t.pos JOIN parted n ON n.clause = c.clause AND n.spec_id = c.spec_id AND abs(n.pos - c.pos) = 1
WHERE NOT EXISTS (SELECT 1 FROM top20 x WHERE x.qid = t.qid AND x.pos = n.pos)""".replace("source AS spec_id, CAST(doc_id // 3", "'one' AS spec_id, CAST(doc_id // 3"),
)
def q11_siblings(spark, sf_dir):
    c = chunks(spark, sf_dir).select("pos", F.lit("one").alias("spec_id"), F.floor(F.col("pos") / 3).cast("string").alias("clause"), F.lit(3).alias("parts"))
    return R.siblings(R.top_n(hybrid(spark, sf_dir), 20), c).select("qid", "pos")


def candidates(spark, sf_dir, held):
    top = R.top_n(hybrid(spark, sf_dir, held), 20)
    return top.select("qid", "pos", F.col("score").alias("fusion"), F.lit(False).alias("pinned"), F.col("rank").alias("ord"))


def scored(spark, sf_dir, rerank=True, held=None):
    held = held or I.tables(chunks(spark, sf_dir))
    return R.scored(settled(candidates(spark, sf_dir, held)), questions(spark, sf_dir), held["chunks"], held["terms"], rerank)


@query("q12_lexical_rerank", f"WITH {S.PAIRS} SELECT qid, pos, round(score, 6) AS score FROM reranked")
def q12_lexical_rerank(spark, sf_dir):
    return scored(spark, sf_dir).select("qid", "pos", six("score"))


@query("q14_fusion_share", f"WITH {S.TOP20} SELECT qid, pos, round(score / max(score) OVER (PARTITION BY qid), 6) AS score FROM top20")
def q14_fusion_share(spark, sf_dir):
    return scored(spark, sf_dir, rerank=False).select("qid", "pos", six("score"))


@query("q15_overlap", f"WITH {S.PAIRS} SELECT qid, pos, round(overlap, 6) AS overlap FROM cover")
def q15_overlap(spark, sf_dir):
    return scored(spark, sf_dir, rerank=False).select("qid", "pos", six("overlap"))


def hits(spark, sf_dir, held=None):
    return settled(R.diversified(scored(spark, sf_dir, held=held)))


@query("q17_diversified", f"WITH {S.HITS} SELECT qid, rank, pos, spec_id, clause, round(score, 6) AS score FROM hits")
def q17_diversified(spark, sf_dir):
    return hits(spark, sf_dir).select("qid", "rank", "pos", "spec_id", "clause", six("score"))


@query("q18_retrieve", f"WITH {S.HITS} SELECT qid, rank, pos, spec_id, clause, round(score, 6) AS score, round(fusion, 8) AS fusion, round(overlap, 6) AS overlap, false AS pinned FROM hits")
def q18_retrieve(spark, sf_dir):
    held = I.tables(chunks(spark, sf_dir))
    h = R.retrieve(held["chunks"], questions(spark, sf_dir), held["terms"], tables=held)
    return h.select("qid", "rank", "pos", "spec_id", "clause", six("score"), F.round("fusion", 8).alias("fusion"), six("overlap"), "pinned")


@query("q18_retrieve_bm25", f"""WITH {S.POSTINGS}, {S.QUERY}, bm AS ({S.bm25()}), top AS ({S.ranked('bm', 20)}),
capped AS (SELECT t.*, c.spec_id, c.clause, row_number() OVER (PARTITION BY t.qid, c.spec_id, c.clause ORDER BY t.rank) AS nth FROM top t JOIN chunks c USING (pos))
SELECT qid, pos, row_number() OVER (PARTITION BY qid ORDER BY rank) AS rank FROM capped WHERE nth <= 2 QUALIFY row_number() OVER (PARTITION BY qid ORDER BY rank) <= 6""")
def q18_retrieve_bm25(spark, sf_dir):
    held = I.tables(chunks(spark, sf_dir), only=R.distinct_terms(questions(spark, sf_dir)))
    return R.retrieve(held["chunks"], questions(spark, sf_dir), held["terms"], mode="bm25", rerank=False, tables=held).select("qid", "pos", "rank")


#: Each document asks for two specifications around its own text; those that ten of eleven documents are of are known.
ASKED = r"""asked AS (SELECT doc_id AS qid, unnest([(20 + doc_id % 19) || '.' || (100 + doc_id % 7), (20 + doc_id % 3) || '.' || (200 + doc_id % 5)]) AS spec_id FROM documents),
named AS (SELECT qid, spec_id FROM asked UNION SELECT doc_id, unnest(regexp_extract_all(text, '(?i)\b(?:TS|TR)\s*(\d{2}\.\d{3})\b', 1)) FROM documents)"""


@query("q19_missing_specs", f"WITH {ASKED} SELECT qid, spec_id FROM named WHERE spec_id NOT IN (SELECT (20 + doc_id % 19) || '.' || (100 + doc_id % 5) FROM documents WHERE doc_id % 11 <> 0)")
def q19_missing_specs(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    spec = lambda a, n, b, m: F.concat((a + F.col("doc_id") % n).cast("string"), F.lit("."), (b + F.col("doc_id") % m).cast("string"))
    q = d.select(F.col("doc_id").alias("qid"), F.concat(F.lit("What does TS "), spec(20, 19, 100, 7), F.lit(" say: "), "text", F.lit(" and tr"), spec(20, 3, 200, 5), F.lit("?")).alias("question"))
    return R.missing_specs(q, d.where("doc_id % 11 <> 0").select(spec(20, 19, 100, 5).alias("spec_id")))


@query(
    "q20_unknown_terms",
    f"""WITH {S.POSTINGS}, {S.QUERY}, cap AS (SELECT qid, question, list_transform(regexp_extract_all(question, '\\b[A-Z][A-Za-z0-9\\-]*\\b'), lambda w: lower(w)) AS cs FROM (SELECT item_id AS qid, 'Zzyzx T9999 zz-top ' || regexp_replace(text, '[^ -~]', 'x', 'g') AS question FROM benchmark)),
asked AS (SELECT DISTINCT qid, unnest({S.tokens('question')}) AS term, cs FROM cap)
SELECT qid, term FROM asked WHERE (regexp_matches(term, '[0-9-]') OR list_contains(cs, term)) AND term NOT IN (SELECT term FROM terms) AND (SELECT count(*) FROM terms) >= 5000""",
)
def q20_unknown_terms(spark, sf_dir):
    q = questions(spark, sf_dir).withColumn("question", F.concat(F.lit("Zzyzx T9999 zz-top "), F.regexp_replace("question", "[^ -~]", "x")))
    return R.unknown_terms(q, chunks(spark, sf_dir)).select("qid", "term")


@query("s10_stored_index", f"WITH {S.HITS} SELECT qid, rank, pos, round(score, 6) AS score FROM hits")
def s10_stored_index(spark, sf_dir):
    """Write an index to the shared folder, read it again, and answer from its tables alone."""
    import uuid

    from clauseforge.session import remove, settled, shared_folder
    from clauseforge.sources import store

    path = f"{shared_folder(spark)}/index-{uuid.uuid4().hex}"
    store.build(chunks(spark, sf_dir), path)
    tables = store.load(spark, path)
    found = R.retrieve(tables["chunks"], questions(spark, sf_dir), tables["terms"], tables=tables).select("qid", "rank", "pos", six("score"))
    found = settled(found)  # a few rows a question
    remove(spark, path)
    return found
