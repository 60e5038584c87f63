"""Ordered operators on series: crossings, islands, filters, neighbours, running values.

keys are the columns of a series, order its order. Series are worked on in parts (see blocks), of `width`
units of the first order column; results don't depend on the width.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ostinato.operators import blocks


def ordered(keys: Sequence[str], *order) -> Window:
    """A plain window, for groups of bounded size such as takes."""
    return Window.partitionBy(*keys).orderBy(*order)


def running_before(x, w) -> Column:
    """Sum of x over the rows before."""
    return F.coalesce(F.sum(x).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("double"))


def before(df: DataFrame, keys: Sequence[str], order: Sequence[str], v: str, name: str, width: float = blocks.ROWS) -> DataFrame:
    """v of the row before as column `name`."""
    x = blocks.neighbour(blocks.parted(df, order[0], width), keys, order, F.struct(F.col(v).alias("v")), name)
    return blocks.tidy(x.withColumn(name, F.col(name)["v"]))


def crossings(df: DataFrame, keys: Sequence[str], order: Sequence[str], v: str, threshold, width: float = blocks.ROWS) -> DataFrame:
    """direction: up where v reaches the threshold from below, down where it falls under it."""
    thr = F.lit(threshold) if isinstance(threshold, (int, float)) else F.col(threshold)
    x = before(df, keys, order, v, "__b", width)
    up, down = (F.col("__b") < thr) & (F.col(v) >= thr), (F.col("__b") >= thr) & (F.col(v) < thr)
    return x.withColumn("direction", F.when(up, "up").when(down, "down")).filter("direction IS NOT NULL").drop("__b")


def islands(df: DataFrame, keys: Sequence[str], order: Sequence[str], active: Column, min_gap: int | Column = 1, width: float = blocks.ROWS) -> DataFrame:
    """Regions of active rows; inactive rows between two of them split them only if there are at least min_gap.

    first and last row (columns first_*, last_* for the order columns), n_active, island numbered from 1.
    """
    keys = list(keys)
    rows = blocks.numbered(df, keys, order, width, "__i").filter(active)
    rows = blocks.neighbour(rows, keys, ["__i"], F.struct("__i"), "__b")
    new = (F.col("__i") - F.col("__b.__i") > min_gap) | F.col("__b").isNull()
    rows = blocks.running_total(rows, keys, ["__i"], new.cast("long"), "island")
    ends = [f for c in order for f in (F.min_by(c, "__i").alias(f"first_{c}"), F.max_by(c, "__i").alias(f"last_{c}"))]
    return rows.groupBy(*keys, "island").agg(*ends, F.count("*").alias("n_active"))


def median_filter(df: DataFrame, keys: Sequence[str], order: Sequence[str], v: str, radius: int, name: str, width: float = blocks.ROWS) -> DataFrame:
    """Median of 2*radius + 1 rows around each as column `name`; missing ones at the ends count as 0."""
    x, w = blocks.with_halo(df, keys, order, radius, width)
    size = 2 * radius + 1
    values = F.collect_list(v).over(w.rowsBetween(-radius, radius))
    padded = F.array_sort(F.concat(values, F.array_repeat(F.lit(0.0), size - F.size(values))))
    return blocks.tidy(x.withColumn(name, F.element_at(padded, radius + 1)).filter("own"))


def change_points(df: DataFrame, keys: Sequence[str], order: Sequence[str], v: str, width: float = blocks.ROWS) -> DataFrame:
    """Rows whose successor has another value, with it as column `next`."""
    x = blocks.neighbour(blocks.parted(df, order[0], width), keys, order, F.struct(F.col(v).alias("v")), "__n", after=True)
    return blocks.tidy(x.withColumn("next", F.col("__n.v")).drop("__n").filter(F.col("next") != F.col(v)))


def rolling(df: DataFrame, keys: Sequence[str], order: Sequence[str], v: str, radius: int, how: Callable[[str], Column], name: str, width: float = blocks.ROWS) -> DataFrame:
    """how(v) over 2*radius + 1 rows as column `name`, 0 where the window isn't full."""
    x, w = blocks.with_halo(df, keys, order, radius, width)
    frame = w.rowsBetween(-radius, radius)
    full = F.count("*").over(frame) == 2 * radius + 1
    return blocks.tidy(x.withColumn(name, F.when(full, how(v).over(frame)).otherwise(F.lit(0.0))).filter("own"))


def local_maxima(df: DataFrame, keys: Sequence[str], order: Sequence[str], v: str, radius: int = 1, width: float = blocks.ROWS) -> DataFrame:
    """Rows above all of the `radius` rows on either side; the first and last row of a series are none."""
    x, w = blocks.with_halo(df, keys, order, radius, width)
    x = x.withColumn("__a", F.max(v).over(w.rowsBetween(-radius, -1))).withColumn("__b", F.max(v).over(w.rowsBetween(1, radius)))
    return blocks.tidy(x.filter(F.col("own") & (F.col(v) > F.col("__a")) & (F.col(v) > F.col("__b"))).drop("__a", "__b"))


def forget_fill(df: DataFrame, keys: Sequence[str], order: Sequence[str], v: str, forget: float, name: str, width: float = blocks.SECONDS) -> DataFrame:
    """v, or the last known value before it if that is at most `forget` seconds old, as column `name`; the first order column is the time."""
    t = order[0]
    seen = F.when(F.col(v).isNotNull(), F.struct(F.col(v).alias("v"), F.col(t).alias("t")))
    x = blocks.known(blocks.parted(df, t, width), keys, order, seen, "__s")
    return blocks.tidy(x.withColumn(name, F.when(F.col(t) - F.col("__s.t") <= forget, F.col("__s.v"))).drop("__s"))


def above_running_maximum(df: DataFrame, keys: Sequence[str], block: str, v: str, percentile: float = 0.99) -> DataFrame:
    """Rows above the threshold of the whole series, the largest of its blocks' percentiles.

    A threshold that only rises while blocks are read ends at that maximum; it doesn't depend on their order.
    """
    p = df.groupBy(*keys, block).agg(F.percentile(v, percentile).alias("__p"))
    top = p.groupBy(*keys).agg(F.max("__p").alias("threshold"))
    return df.join(top, list(keys)).filter(F.col(v) >= F.col("threshold"))


def phrases(df: DataFrame, keys: Sequence[str], order: str, v: str, share: float = 0.01, width: float = blocks.SECONDS) -> DataFrame:
    """Onsets with the next offset: start, end; threshold: `share` of the 99th percentile of v. Open phrases end with the series."""
    keys = list(keys)
    thr = df.groupBy(*keys).agg((F.percentile(v, 0.99) * share).alias("threshold"), F.max(order).alias("__last"))
    x = df.join(thr, keys).withColumn("__on", F.col(v) >= F.col("threshold"))
    x = blocks.neighbour(blocks.parted(x, order, width), keys, [order], F.struct("__on"), "__b")
    was = F.coalesce(F.col("__b.__on"), F.lit(False))
    x = x.withColumn("__edge", F.when(F.col("__on") & ~was, "on").when(~F.col("__on") & was, "off")).filter("__edge IS NOT NULL").drop("__b")
    x = blocks.neighbour(x, keys, [order], F.struct(F.col(order).alias("t")), "__n", after=True)
    return x.filter("__edge = 'on'").select(*keys, F.col(order).alias("start"), F.coalesce("__n.t", "__last").alias("end"), "threshold")


def silences(df: DataFrame, keys: Sequence[str], order: str, v: str, share: float = 0.01, width: float = blocks.SECONDS) -> DataFrame:
    """What lies between phrases: from the start of a series to its first onset, from each offset to the next onset, from the last offset to the end."""
    keys = list(keys)
    p = phrases(df, keys, order, v, share, width)
    ends = df.groupBy(*keys).agg(F.min(order).alias("__first"), F.max(order).alias("__last"))
    edge = F.lit(None).cast("double")
    rows = p.select(*keys, F.col("end").alias("start"), F.col("start").alias("__at")).unionByName(ends.select(*keys, F.col("__first").alias("start"), edge.alias("__at")))
    rows = rows.join(ends, keys).withColumn("__k", F.coalesce("__at", F.lit(float("-inf"))))
    after = blocks.neighbour(rows.withColumn(blocks.PART, F.when(F.col("__at").isNull(), F.floor(F.col("__first") / width) - 1).otherwise(F.floor(F.col("__at") / width))), keys, ["__k"], F.struct(F.col("__at").alias("t")), "__n", after=True)
    return after.select(*keys, "start", F.coalesce("__n.t", "__last").alias("end")).filter("start < end")
