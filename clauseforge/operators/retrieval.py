"""Batch retrieval: every step works on all questions at once, keyed by qid.

Ranks start at 1. Ties go to the lower position, on scores rounded to nine places, so that two
engines that add in different orders still agree. Tables of questions are the stated query set;
those of chunks may be of any size, and only they are partitioned by the number of rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clauseforge.functions import text as T
from clauseforge.operators import batches, blocks
from clauseforge.operators import index as I
from clauseforge.session import settled

#: Weights, bounds and patterns that results depend on.
K1, B = 1.4, 0.72
EXPANSION_WEIGHT = 0.45
UNKNOWN_IDF = 6.0
RRF_K = 60
SPEC_BOOST = 1.55
PIN_BONUS = 1.6
MAX_PINS = 8
MIN_VOCABULARY = 5000
SPEC_REF = r"(?i)\b(?:TS|TR)\s*(\d{2}\.\d{3})\b"
CLAUSE_REF = r"(?i)\b(?:clause|section|subclause)\s+((?:\d+|[A-Z])(?:\.\d+[A-Za-z]?)*)(?![A-Za-z0-9])"
#: Queries that are multiplied at once, and numbers of query vectors that are sent to the workers for one pass.
QUERY_BLOCK = 256
QUERY_VALUES = 1 << 22


def nine(score: Column | str) -> Column:
    return F.round(score, 9)


def sized(df: DataFrame, rows: int = 200_000) -> DataFrame:
    """``df`` to be broadcast if it has ``rows`` rows at most; else as it is, and the join shuffles."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def picked(chunks: DataFrame, rows: DataFrame, *columns: str) -> DataFrame:
    """Columns of the chunks at the positions of ``rows``, which are sent to the chunks if they are few, so that texts stay in place."""
    return chunks.select("pos", *columns).join(sized(rows.select("pos").distinct()), "pos", "left_semi")


def ranked(scores: DataFrame, k: int | None = None, by: str = "qid") -> DataFrame:
    """``scores`` (qid, pos, score) with rank; the first ``k`` of each question."""
    order = Window.partitionBy(by).orderBy(nine("score").desc(), "pos")
    out = scores.withColumn("rank", F.row_number().over(order).cast("long"))
    return out if k is None else out.where(F.col("rank") <= k)


def query_terms(questions: DataFrame, expansions: DataFrame | None = None, weight: float = EXPANSION_WEIGHT) -> DataFrame:
    """(qid, term, w): a term counts as often as it occurs; tokens of expansions at ``weight``."""
    rows = questions.select("qid", F.explode(T.tokens("question")).alias("term"), F.lit(1.0).alias("w"))
    if expansions is not None:
        rows = rows.unionByName(expansions.select("qid", F.explode(T.tokens("expansion")).alias("term"), F.lit(weight).alias("w")))
    return rows.groupBy("qid", "term").agg(F.sum("w").alias("w"))


def distinct_terms(questions: DataFrame) -> DataFrame:
    """(qid, ord, term): a question's distinct terms in order of first mention."""
    return questions.select("qid", F.posexplode(F.array_distinct(T.tokens("question"))).alias("ord", "term"))


def bm25_scores(chunks: DataFrame, terms: DataFrame, text_col: str = "indexed", k1: float = K1, b: float = B, tables: dict[str, DataFrame] | None = None) -> DataFrame:
    """(qid, pos, score) of every chunk that shares a term with a question.

    With the ``tables`` of a stored index only the postings of the questions' terms are read;
    without, the chunks are tokenised and other terms dropped before the shuffle.
    """
    if tables is not None:
        stats, idf, posts = tables["stats"], tables["terms"], tables["postings"]
    else:
        posts, stats = I.corpus(chunks, text_col, only=terms)
        idf = I.term_stats(posts, stats)
    norm = F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl"))
    gain = F.col("w") * F.col("idf") * F.col("tf") * (k1 + 1) / norm
    asked = terms.join(idf.select("term", "idf"), "term")
    # A few rows a question, so their number is soon checked and postings stay in place.
    rows = posts.join(sized(asked), "term").crossJoin(F.broadcast(stats.select("avgdl")))
    return rows.groupBy("qid", "pos").agg(F.sum(gain).alias("score"))


#: Terms of questions, counted by question, that are sent to all tasks.
ASKED_TERMS = 200_000


def bm25_search(chunks: DataFrame, questions: DataFrame, k: int, expansions: DataFrame | None = None, text_col: str = "indexed", tables: dict[str, DataFrame] | None = None) -> DataFrame:
    """(qid, pos, score, rank), scores above zero only.

    A stored index has its postings in blocks of chunks, which are scored where they lie; a set of questions
    that is too large to be sent there is joined with the postings instead.
    """
    terms = settled(query_terms(questions, expansions))
    few = terms.count() <= ASKED_TERMS
    if tables is None and few:
        tables = I.tables(chunks, text_col, only=terms)
    if few and ("blocks" in tables or "batches" in tables):
        asked = tables["terms"].join(F.broadcast(terms), "term").select("qid", "term", (F.col("w") * F.col("idf")).alias("weight"))
        avgdl = tables["stats"].first().avgdl
        if "blocks" in tables:
            return ranked(blocks.search(tables["blocks"], asked, avgdl, k, K1, B), k)
        return ranked(batches.search(tables["batches"], asked, k, batches.bm25(avgdl, K1, B), ["dl"]), k)
    return ranked(bm25_scores(chunks, terms, text_col, tables=tables).where("score > 0"), k)


def dense_search(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(qid, pos, score, rank) of the ``k`` largest dot products; negative ones count too.

    Queries (qid, vector) are sent to all tasks, QUERY_VALUES numbers in one pass over the vectors,
    as a rule all of them. A task multiplies its batches by QUERY_BLOCK queries at a time and keeps the
    best k of each, so what is shuffled does not grow with the vectors of a task.
    """
    import numpy as np
    import pyarrow as pa

    spark, out = vectors.sparkSession, None
    kind = queries.schema["qid"].dataType.simpleString()
    schema = f"qid {kind}, pos long, score double"

    def search(block: list[tuple]) -> DataFrame:
        held = spark.sparkContext.broadcast(([q for q, _ in block], np.array([v for _, v in block], np.float64)))

        def run(batches):
            ids, matrix = held.value
            found = blocks.Best(len(ids), k)
            for batch in batches:
                column, n = batch.column(1), batch.num_rows
                if not n:
                    continue
                x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)
                pos = batch.column(0).to_numpy()
                for a in range(0, len(ids), QUERY_BLOCK):
                    scores = matrix[a : a + QUERY_BLOCK] @ x.T
                    key = np.round(scores, 9)
                    floor = found.least[a : a + QUERY_BLOCK]
                    if n > k:
                        floor = np.maximum(floor, np.partition(key, n - k, axis=1)[:, n - k])
                    q, at = np.nonzero(key >= floor[:, None])
                    found.add(q + a, pos[at], scores[q, at])
            yield from found.rows(pa.array(ids, pa.string() if kind == "string" else pa.int64()))

        return vectors.select("pos", "vector").mapInArrow(run, schema)

    block: list[tuple] = []
    for r in queries.select("qid", "vector").sort("qid").toLocalIterator():
        block.append((r.qid, r.vector))
        if len(block) * len(r.vector) >= QUERY_VALUES:
            out = search(block) if out is None else out.unionByName(search(block))
            block = []
    if block:
        out = search(block) if out is None else out.unionByName(search(block))
    return ranked(spark.createDataFrame([], schema) if out is None else out, k)


def tfidf_search(chunks: DataFrame, questions: DataFrame, k: int, text_col: str = "indexed", min_df: int = 2, max_df: float = 0.6, tables: dict[str, DataFrame] | None = None) -> DataFrame:
    """(qid, pos, score, rank) by the cosine of TF-IDF rows; question terms outside the kept ones are dropped."""
    weighed = None
    if tables is None:
        tables = I.tables(chunks, text_col)
        weighed = I.weighed(tables, min_df, max_df)
        tables["weights"] = batches.weights(weighed)
    elif "weighed" in tables:
        weighed = tables["weighed"]
    weights, n, df = tables["weights"], tables["stats"], tables["terms"].select("term", "df")
    terms = settled(query_terms(questions))
    few = terms.count() <= ASKED_TERMS
    wanted = terms.select("term").distinct()
    df = df.join(F.broadcast(wanted) if few else wanted, "term", "left_semi").crossJoin(F.broadcast(n.select("n")))
    idf = df.where(I.kept(min_df, max_df)).select("term", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))
    q = terms.join(idf, "term").select("qid", "term", "idf", ((1 + F.log("w")) * F.col("idf")).alias("v"))
    norm = F.sqrt(F.sum(F.col("v") * F.col("v")).over(Window.partitionBy("qid")))
    q = q.select("qid", "term", "idf", (F.col("v") / F.greatest(norm, F.lit(1e-9))).alias("v"))
    if weighed is not None and few:
        asked = q.select("qid", "term", (F.col("v") * F.col("idf")).alias("weight"))
        return ranked(batches.search(weighed, asked, k, batches.cosine, ["norm"]), k)
    return ranked(weights.join(sized(q), "term").groupBy("qid", "pos").agg(F.sum(F.col("w") * F.col("v")).alias("score")), k)


# --- fusion and structure ---------------------------------------------------------------------


def rrf(lists: list[tuple[DataFrame, float]], k: int = RRF_K) -> DataFrame:
    """(qid, pos, score, first): reciprocal rank fusion of ranked lists (qid, pos, rank) with weights.

    ``first`` orders ties as a merge that takes one list after the other would meet them.
    """
    rows = None
    for n, (ranks, weight) in enumerate(lists):
        one = ranks.select("qid", "pos", (F.lit(float(weight)) / (k + F.col("rank"))).alias("s"), F.struct(F.lit(n).alias("list"), F.col("rank")).alias("at"))
        rows = one if rows is None else rows.unionByName(one)
    return settled(rows.groupBy("qid", "pos").agg(F.sum("s").alias("score"), F.min("at").alias("first")))


def references(questions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(qid, spec_id) of specifications named, and (qid, clause, spec_hint): the first named one, if any."""
    specs = F.array_distinct(F.regexp_extract_all("question", F.lit(SPEC_REF), F.lit(1)))
    named = questions.select("qid", F.explode(specs).alias("spec_id"))
    clauses = F.array_distinct(F.regexp_extract_all("question", F.lit(CLAUSE_REF), F.lit(1)))
    return named, questions.select("qid", F.explode(clauses).alias("clause"), F.get(specs, 0).alias("spec_hint"))


def boost_specs(fused: DataFrame, chunks: DataFrame, named: DataFrame, factor: float = SPEC_BOOST) -> DataFrame:
    """Scores of candidates from a named specification, multiplied."""
    rows = fused.join(picked(chunks, fused, "spec_id"), "pos").join(named.withColumn("_named", F.lit(True)), ["qid", "spec_id"], "left")
    return rows.withColumn("score", F.col("score") * F.when(F.col("_named"), factor).otherwise(1.0)).drop("_named", "spec_id")


def pins(chunks: DataFrame, clauses: DataFrame, limit: int = MAX_PINS) -> DataFrame:
    """(qid, pos) of the chunks whose clause a question names, in index order, the first ``limit``."""
    rows = chunks.select("pos", "spec_id", "clause").join(clauses, "clause").where(F.col("spec_hint").isNull() | (F.col("spec_hint") == F.col("spec_id")))
    order = Window.partitionBy("qid").orderBy("pos")
    return rows.select("qid", "pos").distinct().withColumn("n", F.row_number().over(order)).where(F.col("n") <= limit).select("qid", "pos")


def add_pins(fused: DataFrame, pinned: DataFrame, k: int = RRF_K, bonus: float = PIN_BONUS) -> DataFrame:
    """Scores with the bonus of pinned positions, which join the candidates if they are not among them."""
    extra = pinned.select("qid", "pos", F.lit(bonus / (k + 1)).alias("score"), F.struct(F.lit(1 << 20).alias("list"), F.col("pos").alias("rank")).alias("first"), F.lit(True).alias("pinned"))
    base = fused.select("qid", "pos", "score", F.struct(F.col("first.list").cast("int").alias("list"), F.col("first.rank").cast("long").alias("rank")).alias("first"), F.lit(False).alias("pinned"))
    return base.unionByName(extra).groupBy("qid", "pos").agg(F.sum("score").alias("score"), F.min("first").alias("first"), F.max("pinned").alias("pinned"))


def keep_specs(fused: DataFrame, chunks: DataFrame, wanted: DataFrame) -> DataFrame:
    """Candidates of the specifications in ``wanted`` (qid, spec_id); questions without rows there keep all."""
    rows = fused.join(picked(chunks, fused, "spec_id"), "pos")
    limited = wanted.select("qid").distinct().withColumn("_limited", F.lit(True))
    allowed = wanted.select("qid", "spec_id").distinct().withColumn("_allowed", F.lit(True))
    rows = rows.join(limited, "qid", "left").join(allowed, ["qid", "spec_id"], "left")
    return rows.where(F.col("_limited").isNull() | F.col("_allowed")).drop("_limited", "_allowed", "spec_id")


def top_n(fused: DataFrame, n: int) -> DataFrame:
    """The first ``n`` by score; ties in the order in which fusion met them, then by position."""
    order = Window.partitionBy("qid").orderBy(nine("score").desc(), "first", "pos")
    return fused.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= n)


def siblings(candidates: DataFrame, chunks: DataFrame, window: int = 1) -> DataFrame:
    """(qid, pos) next to a candidate that is one of several parts: same specification and clause, not yet a candidate."""
    own = picked(chunks.where("parts > 1"), candidates, "spec_id", "clause")
    steps = F.explode(F.array(*(F.lit(d) for d in range(-window, window + 1) if d)))
    near = candidates.select("qid", "pos").join(own, "pos").select("qid", "spec_id", "clause", "pos", steps.alias("d"))
    near = near.select("qid", "spec_id", "clause", (F.col("pos") + F.col("d")).alias("pos"))
    found = near.join(picked(chunks, near, "spec_id", "clause"), ["pos", "spec_id", "clause"]).select("qid", "pos").distinct()
    return found.join(candidates.select("qid", "pos"), ["qid", "pos"], "left_anti")


# --- scores of candidates ---------------------------------------------------------------------


def weighted_terms(questions: DataFrame, idf: DataFrame) -> DataFrame:
    """(qid, terms): distinct terms with their idf, in order, as one array a question.

    The questions' terms are sent to the vocabulary if they are few, so that the rest of it stays in place.
    """
    asked = distinct_terms(questions)
    known = idf.select("term", "idf").join(sized(asked.select("term").distinct()), "term", "left_semi")
    rows = asked.join(known, "term", "left")
    one = F.struct("ord", "term", F.coalesce("idf", F.lit(UNKNOWN_IDF)).alias("idf"))
    return rows.groupBy("qid").agg(F.array_sort(F.collect_list(one)).alias("terms"))


def total(terms: Column, good=None) -> Column:
    """Sum of the idf of the terms, of those that pass ``good``."""
    kept = F.filter(terms, good) if good else terms
    return F.aggregate(kept, F.lit(0.0), lambda a, t: a + t["idf"])


def overlap(terms: Column, text: Column) -> Column:
    """The idf-weighted share of the terms that occur in the lower-cased text as substrings."""
    whole = total(terms)
    share = T.once(text, lambda body: total(terms, lambda t: body.contains(t["term"])))
    return F.when(F.size(terms) > 0, share / F.when(whole == 0, 1.0).otherwise(whole)).otherwise(0.0)


def lexical_score(question: Column, terms: Column, text: Column) -> Column:
    """Between 0 and 1: coverage, bigrams, terms in the heading, and the whole question, all as substrings."""
    n, q = F.size(terms), F.lower(question)
    pairs = F.transform(F.slice(terms, 1, F.greatest(n - 1, F.lit(0))), lambda t, i: F.concat(t["term"], F.lit(" "), F.get(terms, i + 1)["term"]))

    def raw(both: Column) -> Column:
        body, head = both["body"], both["head"]
        phrase = F.size(F.filter(pairs, lambda p: body.contains(p))) / F.greatest(F.size(pairs), F.lit(1))
        heading = F.size(F.filter(terms, lambda t: body.contains(t["term"]) & head.contains(t["term"]))) / F.greatest(n, F.lit(1))
        exact = F.when((F.length(q) > 12) & body.contains(q), 0.15).otherwise(0.0)
        return 0.62 * overlap(terms, body) + 0.18 * phrase + 0.20 * heading + exact

    lower = F.lower(text)
    score = T.once(F.struct(lower.alias("body"), F.substring_index(lower, "\n\n", 1).alias("head")), raw)
    return F.when(n > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))).otherwise(0.0)


def scored(candidates: DataFrame, questions: DataFrame, chunks: DataFrame, idf: DataFrame, rerank: bool = True, text_col: str = "indexed", reranker: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Candidates (qid, pos, fusion) with overlap and score: the reranker's, or the share of the best fusion.

    ``reranker`` gives rows (qid, pos, question, passage) a score between 0 and 1; without one the
    lexical score is taken.
    """
    terms = weighted_terms(questions, idf)
    rows = candidates.join(questions.select("qid", "question"), "qid").join(terms, "qid", "left")
    rows = rows.join(picked(chunks, candidates, "spec_id", "clause", text_col), "pos")
    known = F.coalesce(F.col("terms"), F.array().cast("array<struct<ord:int,term:string,idf:double>>"))
    rows = rows.withColumn("terms", known).withColumn("overlap", overlap(F.col("terms"), F.lower(text_col)))
    if rerank and reranker is not None:
        pairs = reranker(rows.select("qid", "pos", "question", F.col(text_col).alias("passage"))).select("qid", "pos", F.col("score").alias("_score"))
        rows, score = rows.join(pairs, ["qid", "pos"]), F.col("_score")
    elif rerank:
        score = lexical_score(F.col("question"), F.col("terms"), F.col(text_col))
    else:
        best = F.max("fusion").over(Window.partitionBy("qid"))
        score = F.col("fusion") / F.when(best == 0, 1.0).otherwise(best)
    return rows.withColumn("score", score).drop("terms", "question", "_score", text_col)


def diversified(hits: DataFrame, k: int = 6, cap: int = 2) -> DataFrame:
    """Pinned hits first, then by score; ``cap`` of a clause at most; the first ``k`` with their rank."""
    keys = [F.col("pinned").desc(), nine("score").desc(), F.col("ord"), F.col("pos")]
    part = Window.partitionBy("qid", "spec_id", "clause").orderBy(*keys)
    rows = hits.withColumn("_n", F.row_number().over(part)).where(F.col("_n") <= cap).drop("_n")
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(*keys)).cast("long")).where(F.col("rank") <= k)


# --- premises ---------------------------------------------------------------------------------


def missing_specs(questions: DataFrame, chunks: DataFrame) -> DataFrame:
    """(qid, spec_id) named in a question but not in the index."""
    return references(questions)[0].join(chunks.select("spec_id").distinct(), "spec_id", "left_anti").select("qid", "spec_id")


def unknown_terms(questions: DataFrame, chunks: DataFrame, text_col: str = "indexed", least: int = MIN_VOCABULARY, vocabulary: DataFrame | None = None) -> DataFrame:
    """(qid, ord, term): terms shaped like names that no chunk has; none if the vocabulary is small."""
    if vocabulary is None:
        vocabulary = I.tokenised(chunks, text_col).select(F.explode("tokens").alias("term")).distinct()
    size = vocabulary.agg(F.count("*").alias("size"))
    capitals = F.transform(F.regexp_extract_all("question", F.lit(r"\b[A-Z][A-Za-z0-9\-]*\b"), F.lit(0)), F.lower)
    asked = questions.select("qid", F.posexplode(F.array_distinct(T.tokens("question"))).alias("ord", "term"), capitals.alias("capitals"))
    shaped = F.col("term").rlike("[0-9-]") | F.array_contains("capitals", F.col("term"))
    rows = asked.where(shaped).join(vocabulary, "term", "left_anti")
    return rows.crossJoin(F.broadcast(size)).where(F.col("size") >= least).select("qid", "ord", "term")


# --- the whole --------------------------------------------------------------------------------


def ranked_lists(chunks: DataFrame, questions: DataFrame, mode: str, second: DataFrame | None, expansions: DataFrame | None, candidates: int, text_col: str, tables: dict[str, DataFrame] | None) -> dict[str, DataFrame]:
    """The ranked lists (qid, pos, rank) that a mode fuses, by name."""
    if mode not in ("hybrid", "bm25", "dense"):
        raise ValueError(f"unknown mode: {mode}")
    lists = {}
    if mode != "dense":
        lists["bm25"] = bm25_search(chunks, questions, candidates, expansions, text_col, tables)
    if mode != "bm25":
        lists["dense"] = tfidf_search(chunks, questions, candidates, text_col, tables=tables) if second is None else second
    return lists


def diagnostics(questions: DataFrame, lists: dict[str, DataFrame], hits: DataFrame, expansions: DataFrame | None = None) -> DataFrame:
    """(qid, expansions, specs, clauses, bm25, dense, candidates, pinned, hits): what a retrieval did, question by question."""
    named, clauses = references(questions)
    gathered = lambda df, c, name: df.groupBy("qid").agg(F.array_sort(F.collect_set(c)).alias(name))
    out = questions.select("qid")
    for df, c, name in ((named, "spec_id", "specs"), (clauses, "clause", "clauses"), *([] if expansions is None else [(expansions, "expansion", "expansions")])):
        out = out.join(gathered(df, c, name), "qid", "left")
    if expansions is None:
        out = out.withColumn("expansions", F.lit(None).cast("array<string>"))
    every = None
    for name in ("bm25", "dense"):
        ranks = lists.get(name)
        one = None if ranks is None else ranks.select("qid", "pos", F.lit(name).alias("list"))
        every = one if every is None else every if one is None else every.unionByName(one)
    sizes = every.groupBy("qid").agg(*(F.count(F.when(F.col("list") == name, 1)).alias(name) for name in ("bm25", "dense")), F.count_distinct("pos").alias("candidates"))
    found = hits.groupBy("qid").agg(F.count(F.when(F.col("pinned"), 1)).alias("pinned"), F.count("*").alias("hits"))
    out = out.join(sizes, "qid", "left").join(found, "qid", "left").fillna(0, ["bm25", "dense", "candidates", "pinned", "hits"])
    empty = F.array().cast("array<string>")
    return out.withColumns({c: F.coalesce(c, empty) for c in ("expansions", "specs", "clauses")}).select("qid", "expansions", "specs", "clauses", "bm25", "dense", "candidates", "pinned", "hits")


def retrieve(
    chunks: DataFrame,
    questions: DataFrame,
    idf: DataFrame,
    mode: str = "hybrid",
    rerank: bool = True,
    second: DataFrame | None = None,
    expansions: DataFrame | None = None,
    wanted: DataFrame | None = None,
    candidates: int = 50,
    depth: int = 20,
    k: int = 6,
    cap: int = 2,
    window: int = 1,
    text_col: str = "indexed",
    tables: dict[str, DataFrame] | None = None,
    reranker: Callable[[DataFrame], DataFrame] | None = None,
    rrf_k: int = RRF_K,
) -> DataFrame:
    """Final hits of all questions: (qid, rank, pos, spec_id, clause, score, fusion, overlap, pinned).

    ``second`` is the other ranked list (qid, pos, rank): dense search, or TF-IDF where there are no
    vectors. Modes: hybrid, bm25, dense; dense takes no expansions.
    """
    lists = [(ranks, 1.0) for ranks in ranked_lists(chunks, questions, mode, second, expansions, candidates, text_col, tables).values()]
    named, clauses = references(questions)
    fused = add_pins(boost_specs(rrf(lists, rrf_k), chunks, named), pins(chunks, clauses), rrf_k)
    if wanted is not None:
        fused = keep_specs(fused, chunks, wanted)
    top = settled(top_n(fused, depth).select("qid", "pos", F.col("score").alias("fusion"), "pinned", F.col("rank").alias("ord")))
    near = siblings(top, chunks, window).select("qid", "pos", F.lit(0.0).alias("fusion"), F.lit(False).alias("pinned"), (F.col("pos") + (1 << 40)).alias("ord"))
    hits = scored(settled(top.unionByName(near)), questions, chunks, idf, rerank, text_col, reranker)
    return diversified(hits, k, cap).select("qid", "rank", "pos", "spec_id", "clause", "score", "fusion", "overlap", "pinned")
