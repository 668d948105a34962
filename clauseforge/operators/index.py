"""Index tables: postings, document lengths, term statistics, TF-IDF and latent vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clauseforge.functions import text as T
from clauseforge.operators import batches, latent
from clauseforge.session import settled, stored


def tokenised(chunks: DataFrame, text_col: str = "indexed") -> DataFrame:
    """(pos, dl, tokens); the length counts every emitted token, parts included."""
    t = chunks.select("pos", T.tokens(text_col).alias("tokens"))
    return t.select("pos", F.size("tokens").cast("long").alias("dl"), "tokens")


#: Stands for a chunk itself among its terms, so that one pass gives postings and lengths; no token is empty.
MARK = ""


def postings(chunks: DataFrame, text_col: str = "indexed", only: DataFrame | None = None, marked: bool = False) -> DataFrame:
    """(pos, dl, term, tf). With ``only`` (a table of terms) other terms are dropped before the shuffle.

    ``marked``: each chunk also has a row of the term MARK.
    """
    tokens = F.concat("tokens", F.array(F.lit(MARK))) if marked else F.col("tokens")
    rows = tokenised(chunks, text_col).select("pos", "dl", F.explode(tokens).alias("term"))
    if only is not None:
        wanted = only.select("term")
        if marked:
            wanted = wanted.unionByName(chunks.sparkSession.range(1).select(F.lit(MARK).alias("term")))
        rows = rows.join(wanted.distinct(), "term", "left_semi")
    return rows.groupBy("pos", "dl", "term").agg(F.count("*").alias("tf"))


def corpus(chunks: DataFrame, text_col: str = "indexed", only: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Postings and corpus statistics of chunks that are tokenised once; the postings are kept in the shared folder."""
    held = settled(postings(chunks, text_col, only, marked=True))
    stats = held.where(F.col("term") == MARK).agg(F.count("*").alias("n"), F.coalesce(F.avg("dl"), F.lit(1.0)).alias("avgdl"))
    return held.where(F.col("term") != MARK), stats


def tables(chunks: DataFrame, text_col: str = "indexed", only: DataFrame | None = None) -> dict[str, DataFrame]:
    """What searches read of an index, for chunks without a stored one; they are tokenised once.

    The batches, what was counted of them and the terms lie in the shared folder. With ``only`` (a table of terms, few enough to be
    sent to all tasks) the others are left out, and there are no weights.
    """
    kept_terms = None if only is None else only.select("term").distinct().toArrow()["term"].combine_chunks()
    held = stored(batches.made(chunks, text_col, kept_terms), batches.BYTES)
    stats = settled(batches.stats(held))
    counted = stored(batches.counted(held, held.count()), batches.BYTES)
    terms = stored(with_idf(batches.frequencies(counted), stats), batches.BYTES)
    out = {"chunks": chunks, "batches": held, "counted": counted, "postings": batches.postings(held), "stats": stats, "terms": terms}
    if only is None:
        out["kept"] = kept_terms_of(terms, stats)
        out["weighed"] = weighed(out)
        out["weights"] = batches.weights(out["weighed"])
    return out


def kept_terms_of(terms: DataFrame, stats: DataFrame, min_df: int = 2, max_df: float = 0.6) -> DataFrame:
    """(term, df, n) of the terms that TF-IDF keeps."""
    return terms.select("term", "df").crossJoin(F.broadcast(stats.select("n"))).where(kept(min_df, max_df))


def weighed(held: dict[str, DataFrame], min_df: int = 2, max_df: float = 0.6) -> DataFrame:
    """The batches of these tables with the TF-IDF weights of their kept terms."""
    return batches.weighed(held["batches"], held["counted"], held["stats"].first().n, kept_of, min_df, max_df)


def corpus_stats(chunks: DataFrame, text_col: str = "indexed") -> DataFrame:
    """One row: number of chunks and their mean length, 1.0 if there is none."""
    lengths = tokenised(chunks, text_col)
    return lengths.agg(F.count("*").alias("n"), F.coalesce(F.avg("dl"), F.lit(1.0)).alias("avgdl"))


def stats_of(total: DataFrame, chunks: DataFrame) -> DataFrame:
    """The same from the summed lengths (total) of stored postings; chunks without a token count as empty."""
    n = chunks.agg(F.count("*").alias("n"))
    mean = F.when(F.col("n") > 0, F.coalesce("total", F.lit(0)) / F.col("n")).otherwise(1.0)
    return n.crossJoin(F.broadcast(total)).select("n", mean.alias("avgdl"))  # one row each


def term_stats(posts: DataFrame, stats: DataFrame) -> DataFrame:
    """(term, df, idf); idf is above zero for every term."""
    return with_idf(posts.groupBy("term").agg(F.count("*").alias("df")), stats)


def with_idf(df: DataFrame, stats: DataFrame) -> DataFrame:
    """(term, df) with idf."""
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return df.crossJoin(F.broadcast(stats)).select("term", "df", idf.alias("idf"))


#: Fixed value: corpora of fewer chunks keep all terms.
SMALL_CORPUS = 25


def kept_of(df, n, min_df: int, max_df: float):
    """Whether terms of these document frequencies are neither too rare nor too frequent for TF-IDF; columns or arrays."""
    return (n < SMALL_CORPUS) | ((df >= min_df) & (df <= n * max_df))


def kept(min_df: int, max_df: float) -> Column:
    """The same of the columns df and n."""
    return kept_of(F.col("df"), F.col("n"), min_df, max_df)


def tfidf(posts: DataFrame, n: DataFrame, min_df: int = 2, max_df: float = 0.6, df: DataFrame | None = None) -> DataFrame:
    """(pos, term, w): sublinear term frequency by smoothed idf, rows of unit length; ``df`` (term, df) if it is known."""
    df = posts.groupBy("term").agg(F.count("*").alias("df")) if df is None else df.select("term", "df")
    df = df.crossJoin(F.broadcast(n.select("n")))
    idf = df.where(kept(min_df, max_df)).select("term", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))
    raw = posts.join(idf, "term").select("pos", "term", ((1 + F.log(F.col("tf").cast("double"))) * F.col("idf")).alias("w"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("pos")))
    return raw.select("pos", "term", (F.col("w") / F.greatest(norm, F.lit(1e-9))).alias("w"))


def latent_vectors(weights: DataFrame, dims: int = 256, **options) -> tuple[DataFrame, DataFrame]:
    """(pos, vector) of unit length from a truncated decomposition of TF-IDF rows, and the basis (f, term, row)."""
    return latent.latent_vectors(weights, dims, **options)


def encoded(questions: DataFrame, terms: DataFrame, stats: DataFrame, basis: DataFrame, min_df: int = 2, max_df: float = 0.6) -> DataFrame:
    """(qid, vector) of questions (qid, question) on the stored ``basis`` of latent vectors."""
    asked = questions.select("qid", F.explode(T.tokens("question")).alias("term")).groupBy("qid", "term").agg(F.count("*").alias("tf"))
    known = terms.select("term", "df").crossJoin(F.broadcast(stats.select("n"))).where(kept(min_df, max_df))
    weight = (1 + F.log(F.col("tf").cast("double"))) * (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1)
    return latent.encoded(asked.join(known, "term").select("qid", "term", weight.alias("w")), basis)
