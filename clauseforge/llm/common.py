"""What the operators share: column handling, Arrow batch size, checkpoints."""

from __future__ import annotations

from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clauseforge.session import remove, shared_folder

#: Bytes of one Arrow batch sent to a Python worker; a single longer row still goes whole.
BATCH_BYTES = 8 << 20
#: Files of the checkpoints made since the innermost ``passing`` began, if any.
_MADE: ContextVar[list[str] | None] = ContextVar("_MADE", default=None)


def bounded_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small, so that a worker's memory does not depend on row lengths."""
    now = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", "2147483647b")
    if int("".join(c for c in now if c.isdigit())) > BATCH_BYTES:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores in front until no column of ``df`` has them."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        out.append(name)
    return out


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once for a row, also inside nested lambdas."""
    return F.transform(F.array(value), body)[0]


@contextmanager
def passing(spark: SparkSession):
    """Checkpoints that ``cut`` makes within go at the end, also after a failure: what reads them must be written by then."""
    made: list[str] = []
    before = _MADE.set(made)
    try:
        yield
    finally:
        _MADE.reset(before)
        for path in made:
            remove(spark, path)


def cut(df: DataFrame, spent: bool = False) -> DataFrame:
    """``df`` from a checkpoint in the shared folder.

    ``spent``: nothing else reads what ``df`` was made from, so its shuffle files are dropped at once.
    """
    spark = df.sparkSession
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    out = df.checkpoint(eager=True)
    if (made := _MADE.get()) is not None:
        made.append(out._jdf.queryExecution().logical().rdd().getCheckpointFile().get())
    if spent:
        df._jdf.queryExecution().toRdd().cleanShuffleDependencies(True)
    return out
