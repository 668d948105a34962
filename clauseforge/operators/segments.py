"""Running values over an order, in two levels, so that one long group is spread over tasks.

A group is cut into segments by its order. A window runs within each segment, one row a segment says
what the segment adds up to, a window over these few rows carries that along, and each row combines
its own with what came before its segment. So a task holds a segment, not a group.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

#: Values of the order in one segment.
SEGMENT = 1 << 16


def segment(rows: DataFrame, order: list[str], size: int = SEGMENT) -> Column:
    """The segment of a row: its leading order columns up to the first number, of which every ``size`` go together."""
    out = []
    for name in order:
        if isinstance(rows.schema[name].dataType, NumericType):
            out.append(F.floor(F.col(name) / size).alias(f"s{len(out)}"))
            break
        out.append(F.col(name).alias(f"s{len(out)}"))
    return F.struct(*out)


def _joined(rows: DataFrame, few: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with the columns of the one row of ``few`` of the same keys, nulls alike."""
    named = few.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), *(c for c in few.columns if c not in keys))
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)))
    return rows.join(named, same, "left").drop(*(f"_k{i}" for i in range(len(keys))))


def running(rows: DataFrame, by: list[str], order: list[str], size: int = SEGMENT, **of: tuple[str, Column]) -> DataFrame:
    """``rows`` with a column for each ``name=(kind, value)``: sum, min or last non-null value up to the row itself.

    ``order`` has to tell the rows of a group apart for last values.
    """
    inner = {f"_v_{n}": value for n, (_, value) in of.items()}
    cut = rows.withColumns({"_segment": segment(rows, order, size)} | inner)
    keys, at = [*by, "_segment"], F.struct(*order)
    local = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*by).orderBy("_segment").rowsBetween(Window.unboundedPreceding, -1)
    within = {"sum": lambda v: F.sum(v), "min": lambda v: F.min(v), "last": lambda v: F.last(v, ignorenulls=True)}
    whole = within | {"last": lambda v: F.max_by(v, F.when(F.col(v).isNotNull(), at))}
    sums = cut.groupBy(*keys).agg(*(whole[kind](f"_v_{n}").alias(f"_t_{n}") for n, (kind, _) in of.items()))
    carried = sums.select(*keys, *(within[kind](f"_t_{n}").over(before).alias(f"_c_{n}") for n, (kind, _) in of.items()))
    own = cut.withColumns({f"_l_{n}": within[kind](f"_v_{n}").over(local) for n, (kind, _) in of.items()})
    both = _joined(own, carried, keys)
    combined = {
        "sum": lambda c, x: F.when(c.isNull(), x).when(x.isNull(), c).otherwise(c + x),
        "min": lambda c, x: F.least(c, x),
        "last": lambda c, x: F.coalesce(x, c),
    }
    out = both.withColumns({n: combined[kind](F.col(f"_c_{n}"), F.col(f"_l_{n}")) for n, (kind, _) in of.items()})
    return out.drop("_segment", *(f"_{a}_{n}" for n in of for a in "vcl"))


def neighbours(rows: DataFrame, value: str, by: list[str], order: list[str], size: int = SEGMENT, **names: str) -> DataFrame:
    """``rows`` with the value of the row before and of the row after, named by ``before`` and ``after``."""
    cut = rows.withColumn("_segment", segment(rows, order, size))
    keys, at = [*by, "_segment"], F.struct(*order)
    local, along = Window.partitionBy(*keys).orderBy(*order), Window.partitionBy(*by).orderBy("_segment")
    ends = cut.groupBy(*keys).agg(F.max_by(value, at).alias("_z"), F.min_by(value, at).alias("_a"))
    beside = ends.select(*keys, F.lag("_z").over(along).alias("_p"), F.lead("_a").over(along).alias("_n"))
    place = {"_first": F.row_number().over(local) == 1, "_last": F.lead(F.lit(1)).over(local).isNull()}
    own = cut.withColumns({"_lag": F.lag(value).over(local), "_lead": F.lead(value).over(local)} | place)
    both = _joined(own, beside, keys)
    out = both.withColumns({names["before"]: F.when(F.col("_first"), F.col("_p")).otherwise(F.col("_lag")), names["after"]: F.when(F.col("_last"), F.col("_n")).otherwise(F.col("_lead"))})
    return out.drop("_segment", "_p", "_n", "_lag", "_lead", "_first", "_last")
