"""An index as a folder of Parquet tables."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clauseforge.operators import blocks
from clauseforge.operators import index as I
from clauseforge.session import remove

FORMAT = 4


def build(chunks: DataFrame, path: str, forward: DataFrame | None = None, reverse: DataFrame | None = None, text_col: str = "indexed", mode: str = "errorifexists", latent_dims: int = 0, embeddings: str | None = None, vectors: DataFrame | None = None) -> None:
    """Write chunks, postings (by term and in blocks of chunks), TF-IDF weights, term and corpus statistics, vectors, lexicon and meta below ``path``.

    Postings and weights are ranged by term and place, so that a question reads few row groups and
    a frequent term is spread over tasks. With ``latent_dims`` latent vectors and their basis are
    written; with ``embeddings`` the ``vectors`` (pos, vector) of that name. ValueError if there is
    no chunk.
    """
    spark = chunks.sparkSession
    if chunks.isEmpty():
        raise ValueError("there are no chunks to index")
    chunks.write.mode(mode).parquet(f"{path}/chunks")
    chunks = spark.read.parquet(f"{path}/chunks")
    made = I.tables(chunks, text_col)  # chunks are tokenised once; weights need no join of postings
    made["postings"].repartitionByRange("term", "pos").sortWithinPartitions("term", "pos").write.mode(mode).parquet(f"{path}/postings")
    blocks.of_batches(made["batches"]).write.mode(mode).parquet(f"{path}/blocks")
    I.stats_of(blocks.total_length(spark.read.parquet(f"{path}/blocks")), chunks).write.mode(mode).parquet(f"{path}/stats")
    stats = spark.read.parquet(f"{path}/stats")
    I.with_idf(made["terms"].select("term", "df"), stats).sort("term").write.mode(mode).parquet(f"{path}/terms")
    made["weights"].repartitionByRange("term", "pos").sortWithinPartitions("term", "pos").write.mode(mode).parquet(f"{path}/weights")
    for name in ("batches", "counted", "terms"):
        remove(spark, made[name].inputFiles()[0].rpartition("/")[0])
    basis = spark.createDataFrame([], "f int, term string, row array<float>")
    if latent_dims:
        vectors, basis = I.latent_vectors(spark.read.parquet(f"{path}/weights"), latent_dims)
        embeddings = "latent"
    if vectors is None:
        vectors = spark.createDataFrame([], "pos long, vector array<double>")
    vectors.write.mode(mode).parquet(f"{path}/vectors")
    basis.repartitionByRange("term").sortWithinPartitions("term").write.mode(mode).parquet(f"{path}/basis")
    for name, table, schema in (("lexicon", forward, "acronym string, expansion string, ord long"), ("reverse", reverse, "phrase string, acronym string")):
        (spark.createDataFrame([], schema) if table is None else table).write.mode(mode).parquet(f"{path}/{name}")
    meta = spark.createDataFrame([(FORMAT, datetime.now(timezone.utc).isoformat(timespec="seconds"), embeddings or "none")], "format int, built_at string, embeddings string")
    meta.write.mode(mode).parquet(f"{path}/meta")


def load(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of an index; FileNotFoundError if there is none, ValueError if its format is another."""
    from pyspark.errors import AnalysisException

    try:
        meta = spark.read.parquet(f"{path}/meta").first()
    except AnalysisException as e:
        raise FileNotFoundError(f"no index at {path}") from e
    if meta is None or meta.format != FORMAT:
        raise ValueError(f"the index at {path} is of format {meta and meta.format}, not {FORMAT}; build it again")
    return {name: spark.read.parquet(f"{path}/{name}") for name in ("chunks", "postings", "blocks", "weights", "terms", "stats", "lexicon", "reverse", "vectors", "basis", "meta")}


def specs(chunks: DataFrame) -> DataFrame:
    """(spec_id, version, release, chunks): the first version and release seen, and the number of chunks."""
    return chunks.groupBy("spec_id").agg(F.min_by("version", "pos").alias("version"), F.min_by("release", "pos").alias("release"), F.count("*").alias("chunks"))


def clause_text(chunks: DataFrame, spec_id: str, clause: str) -> DataFrame:
    """(spec_id, clause, text): the parts of one clause joined in order; no row if there is none."""
    rows = chunks.where((F.col("spec_id") == spec_id) & (F.col("clause") == clause))
    parts = F.array_sort(F.collect_list(F.struct("part", "text")))
    return rows.groupBy("spec_id", "clause").agg(F.array_join(F.transform(parts, lambda p: p["text"]), "\n\n").alias("text"))


def lookup(lexicon: DataFrame, term: str) -> DataFrame:
    """All expansions of an acronym, in order."""
    return lexicon.where(F.col("acronym") == term.upper()).sort("ord")
