"""Keeps a search index of a growing corpus current, reading each new file once.

The documents folder is a file stream; a run takes the files that came since the last one, in
batches, and ends. A document that was not seen before, or whose text is another than before, is
tokenised and its postings are added; an equal text is skipped. A changed text replaces the earlier
one: its old postings count no more and its terms are counted down. So every figure a search
needs (texts, postings, document frequencies, lengths) is kept without reading the corpus again.

Tables below ``out``, each partitioned by batch:
  documents  pos, spec_id, clause, digest, replaces, text   what was taken in; ``replaces`` is the batch of an earlier text
  postings   pos, dl, term, tf                              by bucket of the term too; the empty term stands for the document
  terms      term, df                                       by how much the batch changed document frequencies
  batches    rows, without_id, ids, taken, replaced         written last: batches that are not listed are not read

A batch reads only tables of earlier batches and what it has written itself, and overwrites its own
partitions, so a batch that was cut off is run again by the stream with the same result; a run
without new files changes nothing. Nothing is cached: a lost executor costs its tasks alone.

Edge cases: null text counts as empty; rows without an id are left out and counted; of rows that
repeat an id in one batch the one with the greatest digest counts; an output made with another
checkpoint is refused; other columns of the documents are not looked at.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clauseforge.operators import index as I
from clauseforge.operators import retrieval as R
from jobs.settings import cluster_session, command, log, stored

DOCUMENTS = "pos long, spec_id string, clause string, digest string, replaces long, text string, batch long"
POSTINGS = "pos long, dl long, term string, tf long, batch long, bucket int"
TERMS = "term string, df long, batch long"
BATCHES = "rows long, without_id long, ids long, taken long, replaced long, batch long"


@dataclass(frozen=True)
class Config:
    documents: str = ""
    out: str = ""
    checkpoint: str = ""
    files_per_batch: int = 1000
    #: Buckets of terms, and tasks that write one of them.
    buckets: int = 64
    spread: int = 16


def latest(documents: DataFrame) -> DataFrame:
    """(pos, spec_id, clause, digest, batch) of each document's last text."""
    row = F.struct("batch", "spec_id", "clause", "digest")
    return documents.groupBy("pos").agg(F.max(row).alias("r")).select("pos", "r.spec_id", "r.clause", "r.digest", "r.batch")


def incoming(rows: DataFrame) -> DataFrame:
    """(pos, spec_id, clause, text, digest) of a batch, one row a document."""
    text = F.coalesce("text", F.lit(""))
    made = rows.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("pos"), F.coalesce("source", F.lit("")).alias("spec_id"), F.coalesce("lang", F.lit("")).alias("clause"), text.alias("text"))
    made = made.withColumn("digest", F.sha2(F.concat_ws("\x00", "spec_id", "clause", "text"), 256))
    return made.groupBy("pos").agg(F.max_by(F.struct("spec_id", "clause", "text", "digest"), "digest").alias("r")).select("pos", "r.*")


def path_and_text() -> Column:
    return F.concat(F.lit("Path: "), "spec_id", F.lit(" > "), "clause", F.lit("\n\n"), "text")


def indexed(rows: DataFrame) -> DataFrame:
    """Documents as chunks: the text that is indexed has its path in front."""
    return rows.select("pos", path_and_text().alias("indexed"))


def read(spark: SparkSession, out: str, name: str, schema: str, before: int | None = None) -> DataFrame:
    """A table of all batches that are complete, or of those before one."""
    rows = stored(spark, f"{out}/{name}", schema)
    if before is not None:
        return rows.where(F.col("batch") < before)
    # One row a batch, checked all the same.
    return rows.join(R.sized(stored(spark, f"{out}/batches", BATCHES).select("batch")), "batch", "left_semi")


def live(spark: SparkSession, out: str, before: int | None = None) -> DataFrame:
    """Postings that count, of all complete batches or of those before one."""
    gone = read(spark, out, "documents", DOCUMENTS, before).where("replaces is not null").select("pos", F.col("replaces").alias("batch"))
    return read(spark, out, "postings", POSTINGS, before).join(R.sized(gone), ["pos", "batch"], "left_anti")


def pattern(path: str) -> str:
    """The path as a pattern that only it matches: a stream takes a plain path for a folder, and it may be one file."""
    path = path.rstrip("/")
    return path if set(path) & set("*?[{") else f"{path[:-1]}[{path[-1]}]"


def take(spark: SparkSession, rows: DataFrame, batch: int, config: Config) -> dict[str, int]:
    """One batch of documents into the tables; its figures."""
    out = config.out

    def write(table: DataFrame, name: str, *by: str) -> None:
        to = table.withColumn("batch", F.lit(batch).cast("long")).write.mode("overwrite")
        to.option("partitionOverwriteMode", "dynamic").partitionBy("batch", *by).parquet(f"{out}/{name}")

    def own(name: str, schema: str) -> DataFrame:
        return stored(spark, f"{out}/{name}", schema).where(F.col("batch") == batch)

    if batch == 0 and not stored(spark, f"{out}/batches", BATCHES).where("batch > 0").isEmpty():
        raise ValueError(f"{out} was filled with another checkpoint than {config.checkpoint}")
    new = incoming(rows)
    ids = rows.select(F.col("doc_id").cast("long").alias("pos")).distinct()
    held = latest(read(spark, out, "documents", DOCUMENTS, batch).join(R.sized(ids), "pos", "left_semi"))
    held = held.select("pos", F.col("digest").alias("had"), F.col("batch").alias("replaces"))
    changed = new.join(held, "pos", "left").where(F.col("had").isNull() | (F.col("had") != F.col("digest")))
    write(changed.select("pos", "spec_id", "clause", "digest", "replaces", "text"), "documents")
    taken = own("documents", DOCUMENTS)
    bucket = F.pmod(F.xxhash64("term"), F.lit(config.buckets)).cast("int")
    posts = I.postings(indexed(taken), marked=True).withColumn("bucket", bucket)
    # A frequent term is spread over tasks, so its bucket has some files.
    posts = posts.repartition("bucket", F.pmod("pos", F.lit(config.spread))).sortWithinPartitions("bucket", "term", "pos")
    write(posts, "postings", "bucket")
    lost = taken.where("replaces is not null").select("pos", F.col("replaces").alias("batch"))
    counted = own("postings", POSTINGS).select("term", F.lit(1).alias("n"))
    if not lost.isEmpty():
        old = live(spark, out, batch).join(R.sized(lost), ["pos", "batch"], "left_semi")
        counted = counted.unionByName(old.select("term", F.lit(-1).alias("n")))
    write(counted.where(F.col("term") != I.MARK).groupBy("term").agg(F.sum("n").cast("long").alias("df")).where("df <> 0"), "terms")
    read_ = rows.agg(F.count("*").alias("rows"), F.count_if(F.col("doc_id").isNull()).alias("without_id"), F.count_distinct("doc_id").alias("ids"))
    kept = taken.agg(F.count("*").alias("taken"), F.count("replaces").alias("replaced"))
    write(read_.crossJoin(F.broadcast(kept)).coalesce(1), "batches")  # one row each
    return own("batches", BATCHES).first().asDict()


def run(spark: SparkSession, config: Config) -> dict[str, int]:
    """Takes in all files that are new, and returns how many batches and rows were read, and documents taken."""
    schema = spark.read.parquet(config.documents).select("doc_id", "text", "lang", "source").schema
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", config.files_per_batch).parquet(pattern(config.documents))
    seen = {"batches": 0, "rows": 0, "taken": 0}

    def one(rows: DataFrame, batch: int) -> None:
        f = take(spark, rows, batch, config)
        log.info("batch %d: read %d rows of %s, %d without an id", batch, f["rows"], config.documents, f["without_id"])
        log.info("batch %d: wrote %d documents, %d of them in place of an earlier text; %d were unchanged", batch, f["taken"], f["replaced"], f["ids"] - f["taken"])
        for key, n in (("batches", 1), ("rows", f["rows"]), ("taken", f["taken"])):
            seen[key] += n

    query = source.writeStream.foreachBatch(one).option("checkpointLocation", config.checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    log.info("wrote %s: %d batches, %d rows read, %d documents taken", config.out, seen["batches"], seen["rows"], seen["taken"])
    return seen


def tables(spark: SparkSession, out: str) -> dict[str, DataFrame]:
    """The index as searches take it: chunks, postings, terms, stats and TF-IDF weights."""
    posts, rows = live(spark, out), read(spark, out, "documents", DOCUMENTS)
    stats = posts.where(F.col("term") == I.MARK).agg(F.count("*").alias("n"), F.coalesce(F.avg("dl"), F.lit(1.0)).alias("avgdl"))
    posts = posts.where(F.col("term") != I.MARK).select("pos", "dl", "term", "tf")
    df = read(spark, out, "terms", TERMS).groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    terms = df.crossJoin(F.broadcast(stats)).select("term", "df", idf.alias("idf"))  # one row of statistics
    gone = rows.where("replaces is not null").select("pos", F.col("replaces").alias("batch"))
    chunks = rows.join(R.sized(gone), ["pos", "batch"], "left_anti")
    chunks = chunks.select("pos", "spec_id", "clause", "digest", "text", path_and_text().alias("indexed"), F.lit(1).alias("parts"))
    return {"chunks": chunks, "postings": posts, "terms": terms, "stats": stats, "weights": I.tfidf(posts, stats, df=terms)}


def main(argv: list[str] | None = None) -> int:
    config = command(Config, argv, __doc__.split("\n")[0])
    spark = cluster_session("index_feed")
    try:
        run(spark, config)
    finally:
        spark.stop()
    return 0


if __name__ == "__main__":
    sys.exit(main())
