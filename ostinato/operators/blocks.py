"""Ordered operators over series of any length: a series is cut into parts, so that no task sorts a whole one.

Within a part an ordinary window does the work; what goes over the edge of a part (the row before, the last
known value, the total so far) comes from a table with one row for each part, which is joined back. Both
sides are hashed by key and part: the large side is shuffled once.

Keys and the first order column must not be null.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROWS = 8192  # width of a part in rows or frames
SECONDS = 64.0  # width of a part in time
PART = "__part"


def parted(df: DataFrame, by: str, width: float) -> DataFrame:
    """df with the part of each row: order column `by` cut into stretches of `width`."""
    return df.withColumn(PART, F.floor(F.col(by) / width))


def _inside(keys: Sequence[str], order: Sequence[str], down: bool = False):
    return Window.partitionBy(*keys, PART).orderBy(*[F.desc(c) if down else F.col(c) for c in order])


def _across(keys: Sequence[str], down: bool = False):
    return Window.partitionBy(*keys).orderBy(F.desc(PART) if down else F.col(PART))


def neighbour(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, name: str, after: bool = False) -> DataFrame:
    """value (a struct) of the row before, or after, as column `name`; null for the first, or last, row of a key."""
    x = df.withColumn("__v", value)
    pick = F.min_by if after else F.max_by
    ends = x.groupBy(*keys, PART).agg(pick("__v", F.struct(*order)).alias("__end"))
    ends = ends.withColumn("__end", F.lag("__end").over(_across(keys, after)))
    x = x.withColumn("__near", F.lag("__v").over(_inside(keys, order, after)))
    return x.join(ends, [*keys, PART]).withColumn(name, F.coalesce("__near", "__end")).drop("__v", "__near", "__end")


def known(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, name: str, after: bool = False) -> DataFrame:
    """The last value (a struct) that isn't null up to each row, or the first from it on, as column `name`."""
    x = df.withColumn("__v", value)
    pick = F.min_by if after else F.max_by
    ends = x.groupBy(*keys, PART).agg(pick("__v", F.when(F.col("__v").isNotNull(), F.struct(*order))).alias("__end"))
    before = _across(keys, after).rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("__end", F.last("__end", ignorenulls=True).over(before))
    upto = _inside(keys, order, after).rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumn("__near", F.last("__v", ignorenulls=True).over(upto))
    return x.join(ends, [*keys, PART]).withColumn(name, F.coalesce("__near", "__end")).drop("__v", "__near", "__end")


def running_total(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, name: str) -> DataFrame:
    """Sum of value up to each row, the row included, as column `name`."""
    x = df.withColumn("__v", value)
    ends = x.groupBy(*keys, PART).agg(F.sum("__v").alias("__end"))
    ends = ends.withColumn("__end", F.sum("__end").over(_across(keys).rowsBetween(Window.unboundedPreceding, -1)))
    x = x.withColumn("__near", F.sum("__v").over(_inside(keys, order).rowsBetween(Window.unboundedPreceding, 0)))
    x = x.join(ends, [*keys, PART])
    return x.withColumn(name, F.coalesce("__near", F.lit(0)) + F.coalesce("__end", F.lit(0))).drop("__v", "__near", "__end")


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[str], width: float, name: str = "pos") -> DataFrame:
    """Place of each row of its key, from 0."""
    x = running_total(parted(df, order[0], width), keys, order, F.lit(1).cast("long"), name)
    return x.withColumn(name, F.col(name) - 1)


def with_halo(df: DataFrame, keys: Sequence[str], order: Sequence[str], radius: int, width: float) -> tuple[DataFrame, Window]:
    """Rows in parts of ROWS rows, with `radius` rows of the neighbouring parts (own is false for those), and the window over a part.

    radius: at most ROWS.
    """
    x = numbered(df, keys, order, width, "__pos")
    own, rest = F.floor(F.col("__pos") / ROWS), F.col("__pos") % ROWS
    beside = F.when(rest < radius, own - 1), F.when(rest >= ROWS - radius, own + 1)
    x = x.withColumn("__own", own).withColumn(PART, F.explode(F.array_compact(F.array(own, *beside))))
    x = x.withColumn("own", F.col("__own") == F.col(PART)).drop("__own")
    return x, Window.partitionBy(*keys, PART).orderBy("__pos")


def tidy(df: DataFrame) -> DataFrame:
    """df without the helper columns of this module."""
    return df.drop(PART, "__pos", "own")
