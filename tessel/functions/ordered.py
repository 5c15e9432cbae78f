"""Order over all rows without one task for all: ranges of positions look at their own rows, and at one row of the ranges before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PART = "__part"


def _ranges(df: DataFrame, position: str) -> DataFrame:
    return df.repartitionByRange(position).withColumn(PART, F.spark_partition_id())


def _before(ends: DataFrame) -> DataFrame:
    """What is known at the end of the ranges before each one; ends has as many rows as there are ranges."""
    w = Window.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    return ends.withColumn("__end", F.last("__end", True).over(w))


def carried(df: DataFrame, position: str, column: str, name: str) -> DataFrame:
    """df with the last non-null value of a column up to each row."""
    d = _ranges(df, position)
    ends = d.groupBy(PART).agg(F.max_by(column, F.when(F.col(column).isNotNull(), F.col(position))).alias("__end"))
    own = F.last(column, True).over(Window.partitionBy(PART).orderBy(position).rowsBetween(Window.unboundedPreceding, 0))
    return d.withColumn(name, own).join(_before(ends), PART).withColumn(name, F.coalesce(name, "__end")).drop(PART, "__end")


def previous(df: DataFrame, position: str, column: str, name: str) -> DataFrame:
    """df with a column's value in the row before; a null one counts as none."""
    d = _ranges(df, position)
    ends = d.groupBy(PART).agg(F.max_by(column, position).alias("__end"))
    inside = d.withColumn(name, F.lag(column).over(Window.partitionBy(PART).orderBy(position)))
    return inside.join(_before(ends), PART).withColumn(name, F.coalesce(name, "__end")).drop(PART, "__end")


def range_join(points: DataFrame, at: Column, intervals: DataFrame, start: Column, end: Column, width: float, keys: list[str] | None = None, how: str = "inner") -> DataFrame:
    """J-15: points with the intervals [start, end) that hold them, by equal numbers of bins of `width` instead of all pairs.

    An interval goes to each bin it touches, a point to one, so every pair meets once. A width near the intervals' usual length is best; keys
    are further columns that must be equal.
    """
    keys = keys or []
    p = points.withColumn("__bin", F.floor(at / width)).withColumn("__at", at)
    i = intervals.withColumn("__from", start).withColumn("__to", end).withColumn("__bin", F.explode(F.sequence(F.floor(start / width), F.floor(end / width)))).where("__from < __to")
    i = i.withColumnsRenamed({k: f"__k_{k}" for k in keys})
    out = p.join(i.withColumnRenamed("__bin", "__bin2"), (F.col("__bin") == F.col("__bin2")) & (F.col("__at") >= F.col("__from")) & (F.col("__at") < F.col("__to")) & _equal(keys), how)
    return out.drop("__bin", "__bin2", "__at", "__from", "__to", *(f"__k_{k}" for k in keys))


def _equal(keys: list[str]) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & (F.col(k) == F.col(f"__k_{k}"))
    return out
