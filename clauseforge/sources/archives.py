"""Archive listings, archive contents, manifests and golden sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clauseforge.functions import text as T

LINK = r'(?i)href="[^"]*?/(\d{4,5})-([0-9a-z]{3})\.zip"'


def list_archives(pages: DataFrame, base: str) -> DataFrame:
    """Listing pages (spec_id, html) to (spec_id, version_code, version, release, url, filename), one row a version."""
    numbers = F.regexp_extract_all("html", F.lit(LINK), F.lit(1))
    codes = F.regexp_extract_all("html", F.lit(LINK), F.lit(2))
    rows = pages.select("spec_id", F.explode(F.arrays_zip(numbers.alias("number"), codes.alias("code"))).alias("a")).select("spec_id", "a.number", F.lower("a.code").alias("version_code"))
    rows = rows.where(F.col("number") == T.flat_id("spec_id")).select("spec_id", "version_code").distinct()
    version = T.decode_version("version_code")
    name = F.concat(T.flat_id("spec_id"), F.lit("-"), "version_code", F.lit(".zip"))
    url = F.concat_ws("/", F.lit(base), T.series_of("spec_id"), "spec_id", name)
    return rows.select("spec_id", "version_code", T.format_version(version).alias("version"), version["major"].alias("release"), url.alias("url"), name.alias("filename"))


def pick(archives: DataFrame, release: int | None = None) -> DataFrame:
    """The newest archive of each specification, of one release if given; specifications without one are left out."""
    rows = archives if release is None else archives.where(F.col("release") == release)
    order = Window.partitionBy("spec_id").orderBy(T.decode_version("version_code").desc())
    return rows.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def require(archives: DataFrame, release: int) -> None:
    """LookupError naming the releases that exist, if a specification lacks the wanted one."""
    lacking = archives.groupBy("spec_id").agg(F.array_sort(F.collect_set("release")).alias("have")).where(~F.array_contains("have", release)).limit(1).collect()
    if lacking:
        raise LookupError(f"release {release} of {lacking[0].spec_id} is not available; there are {lacking[0].have}")


def fetch(spark: SparkSession, mirror: str, specs: list[str], target: str, manifest: str, release: int | None = None) -> int:
    """Copy the newest archive of each specification from a mirror and write a manifest; how many there are.

    ``mirror`` holds SERIES_series/SPEC/index.html beside the archives, on any file system that
    Spark's readers open. A specification without a wanted archive is left out. Archives are
    copied under another name and renamed when whole; one that is there already stays.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path
    conf = spark._jsc.hadoopConfiguration()
    places = {s: f"{mirror}/{s.split('.')[0]}_series/{s}" for s in specs}
    there = {s: p for s, p in places.items() if path(p).getFileSystem(conf).exists(path(f"{p}/index.html"))}
    if not there:
        return 0
    pages = None
    for s, p in there.items():
        one = spark.read.text(f"{p}/index.html", wholetext=True).select(F.lit(s).alias("spec_id"), F.col("value").alias("html"))
        pages = one if pages is None else pages.unionByName(one)
    rows = pick(list_archives(pages, mirror), release).collect()
    to = path(target).getFileSystem(conf)
    for r in rows:
        whole, part = path(f"{target}/{r.filename}"), path(f"{target}/{r.filename}.part")
        if not (to.exists(whole) and to.getFileStatus(whole).getLen() > 0):
            source = path(f"{there[r.spec_id]}/{r.filename}")
            spark._jvm.org.apache.hadoop.fs.FileUtil.copy(source.getFileSystem(conf), source, to, part, False, conf)
            to.rename(part, whole)
    if rows:
        save_manifest(spark.createDataFrame(rows), manifest)
    return len(rows)


def word_parts(spark: SparkSession, path: str) -> DataFrame:
    """Word files of zip archives below ``path``: (archive, name, part, content), in reading order within an archive."""
    import io
    import zipfile

    import pyarrow as pa

    def unzip(batches):
        for batch in batches:
            for where, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with zipfile.ZipFile(io.BytesIO(data)) as z:
                    names = [n for n in z.namelist() if n.lower().endswith((".docx", ".doc"))]
                    for n in names:
                        yield pa.RecordBatch.from_arrays([pa.array([where]), pa.array([n.rsplit("/", 1)[-1]]), pa.array([z.read(n)], pa.binary())], names=["archive", "name", "content"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path).select("path", "content")
    rows = files.mapInArrow(unzip, "archive string, name string, content binary")
    order = Window.partitionBy("archive").orderBy(T.part_order("name"))
    return rows.withColumn("part", F.row_number().over(order))


def load_manifest(spark: SparkSession, path: str) -> DataFrame:
    """A manifest as written by ``save_manifest``, or one JSON array."""
    rows = spark.read.json(path)
    return rows if "_corrupt_record" not in rows.columns else spark.read.json(path, multiLine=True)


def save_manifest(manifest: DataFrame, path: str) -> None:
    manifest.write.mode("overwrite").json(path)


GOLDEN = "id string, question string, expect_answerable boolean, expect_specs array<string>, expect_clauses array<string>, must_include array<string>, must_not_include array<string>"


def load_golden(spark: SparkSession, path: str) -> DataFrame:
    """A golden set: a JSON array of questions, or an object that holds it under "questions"."""
    wrapped = spark.read.schema(f"questions array<struct<{GOLDEN.replace(' string', ':string').replace(' boolean', ':boolean').replace(' array', ':array')}>>, {GOLDEN}").json(path, multiLine=True)
    inner = wrapped.where("questions is not null").select(F.inline("questions"))
    bare = wrapped.where("questions is null and question is not null").drop("questions")
    rows = inner.unionByName(bare)
    empty = F.array().cast("array<string>")
    return rows.withColumns({c: F.coalesce(c, empty) for c in ("expect_specs", "expect_clauses", "must_include", "must_not_include")}).withColumn("expect_answerable", F.coalesce("expect_answerable", F.lit(True)))
