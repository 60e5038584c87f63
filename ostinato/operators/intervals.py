"""Joins of points and intervals in time.

Point-in-interval joins hash points by key and bucket of time, and intervals into every bucket they
touch, so that a join on time is an equi-join: no nested loops, and a long recording is spread over many
tasks. Intervals with a null or NaN end, or that end before they start, hold no point.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ostinato.operators import blocks
from ostinato.session import present

BUCKET_SECONDS = 4.0


def within(t: Column, start: Column, end: Column, closed: str = "both") -> Column:
    """t between start and end; closed: both, left, right or neither."""
    low = t >= start if closed in ("both", "left") else t > start
    high = t <= end if closed in ("both", "right") else t < end
    return low & high


def interval_join(
    points: DataFrame,
    intervals: DataFrame,
    keys: Sequence[str],
    t: str = "t",
    start: str = "start",
    end: str = "end",
    closed: str = "both",
    bucket: float = BUCKET_SECONDS,
    how: str = "inner",
) -> DataFrame:
    """Each point with every interval of the same keys that holds it; how: inner or left."""
    ok = present(start) & present(end) & (F.col(start) <= F.col(end))
    buckets = F.sequence(F.floor(F.col(start) / bucket), F.floor(F.col(end) / bucket))
    spread = intervals.filter(ok).withColumn("__b", F.explode(buckets)).alias("i")
    p = points.withColumn("__b", F.floor(F.col(t) / bucket)).alias("p")
    on = [F.col(f"p.{k}") == F.col(f"i.{k}") for k in [*keys, "__b"]]
    on.append(within(F.col(f"p.{t}"), F.col(f"i.{start}"), F.col(f"i.{end}"), closed))
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    rest = [f"i.{c}" for c in intervals.columns if c not in keys]
    return p.join(spread, cond, how).select("p.*", *rest).drop("__b")


def midpoint_join(inner: DataFrame, outer: DataFrame, keys: Sequence[str], how: str = "inner", closed: str = "both", **names) -> DataFrame:
    """Intervals (start, end) with the intervals (outer_start, outer_end) that hold their middle."""
    mid = inner.withColumn("mid", (F.col("start") + F.col("end")) / 2)
    return interval_join(mid, outer, keys, t="mid", start="outer_start", end="outer_end", closed=closed, how=how, **names)


def contained(inner: DataFrame, outer: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Intervals (start, end) that lie wholly, and without touching its ends, within one (outer_start, outer_end)."""
    return interval_join(inner, outer, keys, t="start", start="outer_start", end="outer_end", closed="neither").filter(F.col("end") < F.col("outer_end"))


def overlapping(left: DataFrame, right: DataFrame, keys: Sequence[str], bucket: float = BUCKET_SECONDS) -> DataFrame:
    """Pairs of intervals (start, end) and (other_start, other_end) of the same keys that overlap, each pair once."""
    b = lambda s, e: F.sequence(F.floor(F.col(s) / bucket), F.floor(F.col(e) / bucket))
    x = left.withColumn("__b", F.explode(b("start", "end"))).alias("x")
    y = right.withColumn("__b", F.explode(b("other_start", "other_end"))).alias("y")
    cond = F.col("x.__b") == F.col("y.__b")
    for k in keys:
        cond = cond & (F.col(f"x.{k}") == F.col(f"y.{k}"))
    meet = F.greatest(F.col("x.start"), F.col("y.other_start"))
    cond = cond & (F.col("x.start") < F.col("y.other_end")) & (F.col("y.other_start") < F.col("x.end"))
    # The pair meets in several buckets; the one where the overlap begins counts.
    cond = cond & (F.floor(meet / bucket) == F.col("x.__b"))
    rest = [f"y.{c}" for c in right.columns if c not in keys]
    return x.join(y, cond).select("x.*", *rest).drop("__b")


def last_wins(points: DataFrame, intervals: DataFrame, keys: Sequence[str], point: Sequence[str], order: str, take: Sequence[str], **join) -> DataFrame:
    """Each point once, with the columns `take` of the interval of highest `order` that holds it, or nulls.

    point: columns that tell points apart.
    """
    hit = interval_join(points, intervals, keys, how="left", **join)
    best = hit.groupBy(*keys, *point).agg(F.max(F.struct(order, *take)).alias("__best"))
    return best.select(*keys, *point, *[F.col(f"__best.{c}").alias(c) for c in take])


def _timeline(points: DataFrame, marks: DataFrame, carried: Sequence[str], point_place: int, mark_place: int) -> DataFrame:
    """Points (t) and marks (mark_t) on one line of time in parts; __place orders them at equal times."""
    p = points.select("*", F.lit(False).alias("__mark"), F.lit(point_place).alias("__place"), *[F.lit(None).cast(marks.schema[c].dataType).alias(c) for c in ["mark_t", *carried]])
    m = marks.withColumns({"t": F.col("mark_t"), "__mark": F.lit(True), "__place": F.lit(mark_place)})
    return blocks.parted(p.unionByName(m, allowMissingColumns=True).filter(present("t")), "t", blocks.SECONDS)


def asof(points: DataFrame, marks: DataFrame, keys: Sequence[str], carried: Sequence[str], direction: str = "backward", strict: bool = False) -> DataFrame:
    """Each point with mark_t and `carried` of the last mark at or before it (backward) or the first at or after it (forward).

    strict: a mark at the same time doesn't count. Of marks at the same time the one with the largest `carried` is taken.
    Points without a time are left out; keys must not be null.
    """
    # Of marks at the same time only the largest is kept.
    m = marks.groupBy(*keys, "mark_t").agg(F.max(F.struct(*carried)).alias("__c")).select(*keys, "mark_t", *[F.col(f"__c.{c}").alias(c) for c in carried])
    before = direction == "backward"
    line = _timeline(points, m, carried, 1, 0 if before != strict else 2)
    packed = F.when(F.col("__mark"), F.struct("mark_t", *carried))
    out = blocks.known(line, keys, ["t", "__place"], packed, "__got", after=not before).filter("NOT __mark")
    return out.select(*points.columns, "__got.mark_t", *[f"__got.{c}" for c in carried])


def lerp(points: DataFrame, marks: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """Each point (t) with `value` of the marks (mark_t, value) interpolated at its time; beyond the first and last mark their value."""
    m = marks.groupBy(*keys, "mark_t").agg(F.max(value).alias(value))
    packed = F.when(F.col("__mark"), F.struct(F.col("mark_t").alias("t"), F.col(value).alias("v")))
    x = blocks.known(_timeline(points, m, [value], 1, 0), keys, ["t", "__place"], packed, "__a")
    x = x.withColumn("__place", F.when(F.col("__mark"), 2).otherwise(1))
    x = blocks.known(x, keys, ["t", "__place"], packed, "__b", after=True).filter("NOT __mark")
    share = (F.col("t") - F.col("__a.t")) / F.nullif(F.col("__b.t") - F.col("__a.t"), F.lit(0.0))
    mid = F.col("__a.v") + (F.col("__b.v") - F.col("__a.v")) * share
    v = F.when(F.col("__a.t") == F.col("t"), F.col("__a.v")).otherwise(F.coalesce(mid, "__a.v", "__b.v"))
    return x.select(*points.columns, v.alias(value))


def nearest_interval(points: DataFrame, intervals: DataFrame, keys: Sequence[str], label: str) -> DataFrame:
    """Each point with start, end and `label` of the nearest interval of the same keys (0 within it; ties: the earlier start).

    Intervals of a key must not overlap: then the nearest one is the last that starts at or before the point, or the next.
    """
    m = intervals.select(*keys, F.col("start").alias("mark_t"), "end", label)
    packed = F.when(F.col("__mark"), F.struct("mark_t", "end", label))
    x = blocks.known(_timeline(points, m, ["end", label], 1, 0), keys, ["t", "__place", "end"], packed, "__a")
    x = x.withColumn("__place", F.when(F.col("__mark"), 2).otherwise(1))
    x = blocks.known(x, keys, ["t", "__place", "end"], packed, "__b", after=True).filter("NOT __mark")
    before = F.greatest(F.lit(0.0), F.col("t") - F.col("__a.end"))
    after = F.col("__b.mark_t") - F.col("t")
    best = F.when(F.col("__b").isNull() | (before <= after), F.col("__a")).otherwise(F.col("__b"))
    best = F.when(F.col("__a").isNull(), F.col("__b")).otherwise(best)
    return x.withColumn("__best", best).select(*points.columns, F.col("__best.mark_t").alias("start"), F.col("__best.end").alias("end"), F.col(f"__best.{label}").alias(label))


def tolerant_union(first: DataFrame, second: DataFrame, keys: Sequence[str], tolerance: float, t: str = "t") -> DataFrame:
    """All times of first, and those of second that aren't nearer than tolerance to any of them."""
    near = first.select(*keys, (F.col(t) - tolerance).alias("start"), (F.col(t) + tolerance).alias("end"))
    held = interval_join(second, near, keys, t=t, closed="neither", bucket=max(BUCKET_SECONDS, 4 * tolerance)).select(*keys, t).distinct()
    rest = second.select(*keys, t).join(held, [*keys, t], "left_anti")
    return first.select(*keys, t).unionByName(rest)
