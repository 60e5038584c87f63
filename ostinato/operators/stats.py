"""Statistics of series within intervals, and of groups."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ostinato.functions.exprs import col, exact_avg, wrap


def third_of(t, start, end) -> Column:
    """1, 2 or 3: the third of the interval t lies in; edges belong to the later third, the end to the last."""
    share = 3 * (col(t) - col(start)) / F.nullif(col(end) - col(start), F.lit(0.0))
    return F.greatest(F.lit(1), F.least(F.lit(3), (F.floor(share) + 1).cast("int")))


def base_stats(joined: DataFrame, keys: Sequence[str], t: str = "t", v: str = "v", start: str = "start", end: str = "end") -> DataFrame:
    """Ten statistics of the values within each interval: avg (median), var (interquartile range), trend (slope over
    time), time and value of the maximum and minimum (the earliest), and the means of the three thirds; n counts values."""
    third = third_of(t, start, end)
    q = F.percentile(v, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    x = joined.groupBy(*keys).agg(
        F.count(v).alias("n"),
        q.alias("q"),
        F.regr_slope(v, t).alias("trend"),
        F.max(F.struct(v, (-F.col(t)).alias("t"))).alias("top"),
        F.min(F.struct(v, t)).alias("low"),
        *[exact_avg(F.when(third == i, F.col(v))).alias(f"t{i}") for i in (1, 2, 3)],
    )
    return x.select(
        *keys, "n", F.col("q")[1].alias("avg"), (F.col("q")[2] - F.col("q")[0]).alias("var"), "trend",
        (-F.col("top.t")).alias("max_t"), F.col(f"top.{v}").alias("max_v"), F.col(f"low.{t}").alias("min_t"), F.col(f"low.{v}").alias("min_v"), "t1", "t2", "t3",
    )


def angle_stats(joined: DataFrame, keys: Sequence[str], re: str = "re", im: str = "im", t: str = "t") -> DataFrame:
    """Statistics of a complex series: median and interquartile range of its modulus; of its angle the direction of
    the median point (avg), and interquartile range and trend of the deviations from it, each within half a turn.
    Points at 0 have no angle."""
    keys = list(keys)
    angle = F.when(F.hypot(re, im) > 0, F.atan2(im, re))
    centre = joined.groupBy(*keys).agg(
        F.percentile(re, 0.5).alias("__re"), F.percentile(im, 0.5).alias("__im"), F.percentile(F.hypot(re, im), F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("__q"), F.count("*").alias("n")
    )
    centre = centre.withColumn("arg_avg", F.atan2("__im", "__re"))
    dev = joined.join(centre, keys).withColumn("__d", wrap(angle - F.col("arg_avg"), 2 * math.pi))
    return dev.groupBy(*keys).agg(
        F.first("n").alias("n"),
        F.first(F.col("__q")[1]).alias("abs_avg"),
        F.first(F.col("__q")[2] - F.col("__q")[0]).alias("abs_var"),
        F.first("arg_avg").alias("arg_avg"),
        (F.percentile("__d", 0.75) - F.percentile("__d", 0.25)).alias("arg_var"),
        F.regr_slope("__d", t).alias("arg_trend"),
    )


def angle_extremes(joined: DataFrame, keys: Sequence[str], re: str = "re", im: str = "im", t: str = "t", start: str = "start", end: str = "end") -> DataFrame:
    """What angle_stats leaves out: highest and lowest modulus (to six decimals) with their times (the earliest), the deviations of the angle
    that are largest and smallest, the direction of the median point added, and the medians of modulus and deviation of the three thirds."""
    keys = list(keys)
    centre = joined.groupBy(*keys).agg(F.percentile(re, 0.5).alias("__re"), F.percentile(im, 0.5).alias("__im")).withColumn("__c", F.atan2("__im", "__re"))
    angle = F.when(F.hypot(re, im) > 0, F.atan2(im, re))
    x = joined.join(centre, keys).withColumn("__a", F.round(F.hypot(re, im), 6)).withColumn("__d", wrap(angle - F.col("__c"), 2 * math.pi)).withColumn("__third", third_of(t, start, end))
    part = lambda v, i: F.percentile(F.when(F.col("__third") == i, F.col(v)), 0.5)
    g = x.groupBy(*keys).agg(
        F.max(F.struct("__a", (-F.col(t)).alias("t"))).alias("top"), F.min(F.struct("__a", t)).alias("low"), F.max(F.col("__d") + F.col("__c")).alias("arg_max_v"), F.min(F.col("__d") + F.col("__c")).alias("arg_min_v"),
        *[part("__a", i).alias(f"abs_t{i}") for i in (1, 2, 3)], *[part("__d", i).alias(f"arg_t{i}") for i in (1, 2, 3)],
    )
    return g.select(
        *keys, F.col("top.__a").alias("abs_max_v"), (-F.col("top.t")).alias("abs_max_t"), F.col("low.__a").alias("abs_min_v"), F.col(f"low.{t}").alias("abs_min_t"),
        "arg_max_v", "arg_min_v", "abs_t1", "abs_t2", "abs_t3", "arg_t1", "arg_t2", "arg_t3",
    )


def quadratic(df: DataFrame, keys: Sequence[str], order: Sequence[str], v: str, beyond: int = 5) -> DataFrame:
    """Parabola through the values of each group in order, by least squares: value `beyond` places before the first and after the last, n.

    Places run from -1 to 1, where the normal equations are well conditioned; groups of fewer than three rows give none.
    """
    keys = list(keys)
    w = Window.partitionBy(*keys)
    n = F.count("*").over(w)
    place = (2.0 * (F.row_number().over(w.orderBy(*order)) - 1) / (n - 1)) - 1.0
    x = df.withColumn("__n", n).filter("__n >= 3").withColumn("__n", n).withColumn("__u", place)
    u, y = F.col("__u"), F.col(v).cast("double")
    s = x.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(u * u).alias("s2"), F.sum(u * u * u * u).alias("s4"), F.sum(y).alias("y0"), F.sum(u * y).alias("y1"), F.sum(u * u * y).alias("y2"))
    # Odd sums vanish, as places lie evenly about 0.
    det = F.col("n") * F.col("s4") - F.col("s2") * F.col("s2")
    c = (F.col("n") * F.col("y2") - F.col("s2") * F.col("y0")) / det
    a = (F.col("s4") * F.col("y0") - F.col("s2") * F.col("y2")) / det
    b = F.col("y1") / F.col("s2")
    far = 1 + 2.0 * beyond / (F.col("n") - 1)
    return s.select(*keys, "n", (a - b * far + c * far * far).alias("before"), (a + b * far + c * far * far).alias("after"))


def percentiles(df: DataFrame, keys: Sequence[str], v: str, at: Sequence[float]) -> DataFrame:
    """Percentiles p05, p50, ... of each group."""
    x = df.groupBy(*keys).agg(F.percentile(v, F.array(*[F.lit(float(p)) for p in at])).alias("q"))
    return x.select(*keys, *[F.col("q")[i].alias(f"p{round(100 * p):02d}") for i, p in enumerate(at)])


def silence_voice(df: DataFrame, keys: Sequence[str], v: str) -> DataFrame:
    """Typical values of silence and voice: medians on either side of the geometric mean of the 1st and 99th percentile."""
    edge = df.groupBy(*keys).agg(F.percentile(v, F.array(F.lit(0.01), F.lit(0.99))).alias("q"))
    edge = edge.select(*keys, F.sqrt(F.greatest(F.col("q")[0], F.lit(0.0)) * F.greatest(F.col("q")[1], F.lit(0.0))).alias("threshold"))
    x = df.join(edge, list(keys))
    return x.groupBy(*keys).agg(
        F.first("threshold").alias("threshold"),
        F.percentile(F.when(F.col(v) <= F.col("threshold"), F.col(v)), 0.5).alias("silence"),
        F.percentile(F.when(F.col(v) > F.col("threshold"), F.col(v)), 0.5).alias("voice"),
    )


def normalised(df: DataFrame, keys: Sequence[str], v: str, mode: str = "std") -> DataFrame:
    """v as column `normal`: std (mean and population deviation), iqr (median and interquartile range), minmax, p5_p95
    (5th and 95th percentile become 0 and 1) or peak (largest absolute value); null where there's no spread."""
    if mode not in ("std", "iqr", "minmax", "p5_p95", "peak"):
        raise ValueError(f"no normalisation {mode}")
    g = df.groupBy(*keys)
    if mode == "std":
        s = g.agg(exact_avg(v).alias("__a"), F.stddev_pop(v).alias("__b"))
    elif mode == "iqr":
        q = F.percentile(v, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
        s = g.agg(q.alias("__q")).select(*keys, F.col("__q")[1].alias("__a"), (F.col("__q")[2] - F.col("__q")[0]).alias("__b"))
    elif mode == "p5_p95":
        q = F.percentile(v, F.array(F.lit(0.05), F.lit(0.95)))
        s = g.agg(q.alias("__q")).select(*keys, F.col("__q")[0].alias("__a"), (F.col("__q")[1] - F.col("__q")[0]).alias("__b"))
    elif mode == "peak":
        s = g.agg(F.lit(0.0).alias("__a"), F.max(F.abs(v)).alias("__b"))
    else:
        s = g.agg(F.min(v).alias("__a"), (F.max(v) - F.min(v)).alias("__b"))
    return df.join(s, list(keys)).withColumn("normal", (F.col(v) - F.col("__a")) / F.nullif(F.col("__b"), F.lit(0.0))).drop("__a", "__b")


def weighted_quantiles(df: DataFrame, keys: Sequence[str], v: str, weight: str, at: Sequence[float], order: str) -> DataFrame:
    """Quantiles of weighted values: value i sits at the share of weight below its middle; between them by interpolation."""
    w = Window.partitionBy(*keys).orderBy(v, order)
    upto = F.sum(weight).over(w.rowsBetween(Window.unboundedPreceding, 0))
    x = df.withColumn("__pos", (upto - F.col(weight) / 2) / F.sum(weight).over(Window.partitionBy(*keys)))
    x = x.select(*keys, v, "__pos", F.lead(v).over(w).alias("__v2"), F.lead("__pos").over(w).alias("__p2"), F.row_number().over(w).alias("__i"))
    out = []
    for p in at:
        pos, nxt = F.col("__pos"), F.col("__p2")
        inside = (pos <= p) & (nxt > p)
        lerp = F.col(v) + (F.col("__v2") - F.col(v)) * (p - pos) / F.nullif(nxt - pos, F.lit(0.0))
        first = (F.col("__i") == 1) & (pos > p)
        last = nxt.isNull() & (pos <= p)
        out.append(F.max(F.when(inside, lerp).when(first | last, F.col(v))).alias(f"q{round(100 * p):02d}"))
    return x.groupBy(*keys).agg(*out)


def most_frequent(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """The most frequent value of each group (ties: the smallest); null only if all are."""
    n = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("__n"))
    w = Window.partitionBy(*keys).orderBy(F.desc("__n"), value)
    return n.withColumn("__r", F.row_number().over(w)).filter("__r = 1").select(*keys, value)


def centred(df: DataFrame, keys: Sequence[str], v: str, how: str = "mean") -> DataFrame:
    """v less the mean or median of its group, as column `centred`."""
    middle = exact_avg(v) if how == "mean" else F.percentile(v, 0.5)
    m = df.groupBy(*keys).agg(middle.alias("__m"))
    return df.join(m, list(keys)).withColumn("centred", F.col(v) - F.col("__m")).drop("__m")
