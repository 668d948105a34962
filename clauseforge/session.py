"""Session defaults shared by the tests, the bench and command-line use."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from contextlib import contextmanager
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession


def local_session(name: str = "clauseforge", cpus: str | None = None) -> SparkSession:
    """A local session; on a cluster the caller brings its own."""
    cpus = cpus or os.environ.get("BENCH_CPUS", "8")
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@lru_cache(maxsize=1)
def own_folder() -> str:
    """A folder of this process, removed at its end."""
    path = tempfile.mkdtemp()
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return path


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir, which all executors share.

    Without that setting a local session gets an own one; on a cluster nothing is guessed.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
    return own_folder()


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of whatever file system it lies in."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def sending(spark: SparkSession, batch_bytes: int | None):
    """What runs within sends a Python worker so many bytes of rows at once, or one longer row; None: as the session has it."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    try:
        if batch_bytes:
            spark.conf.set(name, str(batch_bytes))
        yield
    finally:
        if batch_bytes:
            spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def settled(df: DataFrame, batch_bytes: int | None = None) -> DataFrame:
    """``df`` from a checkpoint in the shared folder: for small results that many plans read.

    ``batch_bytes``: what a Python worker gets at once while it is made.
    """
    spark = df.sparkSession
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    with sending(spark, batch_bytes):
        return df.checkpoint(eager=True)


def stored(df: DataFrame, batch_bytes: int | None = None) -> DataFrame:
    """``df`` from a Parquet folder in the shared folder: for large results that several plans read parts of.

    ``batch_bytes``: what a Python worker gets at once while it is written; also about what a row group holds, which
    a writer keeps and a reader loads as a whole, however many rows of some MB a task has.
    """
    spark, path = df.sparkSession, f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    small = {"parquet.block.size": batch_bytes, "parquet.page.size.row.check.min": 1, "parquet.page.size.row.check.max": 1} if batch_bytes else {}
    with sending(spark, batch_bytes):
        df.write.options(**small).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
