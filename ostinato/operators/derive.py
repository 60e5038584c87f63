"""Derived columns of notes: context, tempo, bars, runs, bounds of sound."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ostinato.operators import intervals
from ostinato.operators.windows import ordered, running_before
from ostinato.session import broadcast_if_small, checkpointed


def error_bits(bits: Mapping[int, Column]) -> Column:
    """Sum of the bits whose condition holds."""
    out = F.lit(0)
    for bit, cond in bits.items():
        out = out + F.when(cond, F.lit(bit)).otherwise(F.lit(0))
    return out


def mean_of_known(*columns: str) -> Column:
    """Mean of those columns that aren't null."""
    total, n = F.lit(0.0), F.lit(0)
    for c in columns:
        total = total + F.coalesce(F.col(c), F.lit(0.0))
        n = n + F.col(c).isNotNull().cast("int")
    return total / F.nullif(n, F.lit(0))


def bar_positions(df: DataFrame, keys: Sequence[str], order: Sequence[str], bar: int) -> DataFrame:
    """beat_start, the beats before each note, and on_bar: is it a whole number of bars from the first strong note."""
    w = ordered(keys, *order)
    x = df.withColumn("beat_start", running_before(F.col("beats"), w))
    anchor = F.min(F.when(F.col("strong"), F.col("beat_start"))).over(Window.partitionBy(*keys))
    return x.withColumn("on_bar", F.coalesce(F.pmod(F.col("beat_start") - anchor, F.lit(float(bar))) == 0, F.lit(False)))


def local_tempo(notes: DataFrame, keys: Sequence[str], key: str, radius: float) -> DataFrame:
    """Notes a minute among the notes of the take that overlap each note widened by radius seconds on either side."""
    a = notes.select(*keys, key, (F.col("start") - radius).alias("start"), (F.col("end") + radius).alias("end"), (F.col("end") - F.col("start")).alias("own"))
    b = notes.select(*keys, F.col("start").alias("other_start"), F.col("end").alias("other_end"))
    near = intervals.overlapping(a, b, keys)
    g = near.groupBy(key, "own").agg((60 * F.count("*") / F.sum(F.col("other_end") - F.col("other_start"))).alias("tempo"))
    return g.select(key, "tempo", (60 / F.nullif(F.col("own"), F.lit(0.0))).alias("own_tempo"))


def beats_around(notes: DataFrame, keys: Sequence[str], order: Sequence[str], bar: float) -> DataFrame:
    """Tempo in beats a minute of each strict note (beats, seconds, strict): own_tempo, and tempo, of the strict notes whose beats overlap a bar on either side."""
    w = ordered(keys, *order)
    x = notes.withColumn("start", running_before(F.col("beats"), w)).filter("strict")
    a = x.select(*keys, *order, "beats", "seconds", (F.col("start") - bar).alias("start"), (F.col("start") + bar).alias("end"))
    b = x.select(*keys, F.col("start").alias("other_start"), (F.col("start") + F.col("beats")).alias("other_end"), F.col("beats").alias("other_beats"), F.col("seconds").alias("other_seconds"))
    near = intervals.overlapping(a, b, keys, bucket=4 * bar)
    g = near.groupBy(*keys, *order, "beats", "seconds").agg((60 * F.sum("other_beats") / F.nullif(F.sum(F.col("other_seconds").cast("decimal(28,6)")).cast("double"), F.lit(0.0))).alias("tempo"))
    return g.select(*keys, *order, "tempo", (60 * F.col("beats") / F.nullif(F.col("seconds"), F.lit(0.0))).alias("own_tempo"), (60 * F.col("beats") / F.nullif(F.col("tempo"), F.lit(0.0))).alias("expected"))


def bar_positions_reset(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """beat_in_bar: the beats since the last strong note, counted from the start before the first one."""
    w = ordered(keys, *order)
    x = df.withColumn("__bar", F.sum(F.col("strong").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return x.withColumn("beat_in_bar", running_before(F.col("beats"), ordered([*keys, "__bar"], *order))).drop("__bar")


def neighbour_context(df: DataFrame, keys: Sequence[str], order: Sequence[str], most: float) -> DataFrame:
    """prev_gap and next_gap, from the start before and to the end after, and context: half the smaller, at most `most`."""
    w = ordered(keys, *order)
    last = F.max("end").over(Window.partitionBy(*keys))
    x = df.withColumn("prev_gap", F.col("start") - F.coalesce(F.lag("start").over(w), F.lit(0.0)))
    x = x.withColumn("next_gap", F.coalesce(F.lead("end").over(w), last) - F.col("end"))
    return x.withColumn("context", F.least(F.lit(most), F.col("prev_gap") / 2, F.col("next_gap") / 2))


def inter_onset(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    own = F.col("end") - F.col("start")
    x = df.withColumn("ioi", F.coalesce(F.lead("start").over(ordered(keys, *order)) - F.col("start"), own))
    return x.withColumn("sounding_share", own / F.nullif(F.col("ioi"), F.lit(0.0)))


def group_ordinal(df: DataFrame, group: str, name: str) -> DataFrame:
    """Number of each row's group among the sorted groups, from 0; null has no number.

    The groups are sorted across partitions; each one's groups are numbered within it and moved on by how many the ones before hold.
    """
    g = df.filter(F.col(group).isNotNull()).select(group).distinct().repartitionByRange(group).withColumn("__part", F.spark_partition_id())
    g = checkpointed(g)
    held = g.groupBy("__part").agg(F.count("*").alias("__n"))  # a row for each partition
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    held = held.withColumn("__before", before).drop("__n")
    number = F.row_number().over(Window.partitionBy("__part").orderBy(group)) - 1
    g = g.join(F.broadcast(held), "__part").withColumn(name, (number + F.col("__before")).cast("long")).select(group, name)
    return df.join(broadcast_if_small(g), group)


def runs(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """run: number of the run of equal values each row belongs to, from 1; a null differs from everything."""
    w = ordered(keys, *order)
    new = F.when(F.col(value) == F.lag(value).over(w), 0).otherwise(1)
    x = df.withColumn("__new", new)
    return x.withColumn("run", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")


def sounding_bounds(points: DataFrame, notes: DataFrame, keys: Sequence[str], key: str, margin: float) -> DataFrame:
    """onset, the last rise above the threshold before the middle of a note, and offset, the first fall below it after.

    The threshold is the geometric mean of the note's least value and its 99th percentile.
    """
    wide = notes.select(*keys, key, (F.col("start") - margin).alias("start"), (F.col("end") + margin).alias("end"), ((F.col("start") + F.col("end")) / 2).alias("mid"))
    j = intervals.interval_join(points, wide, keys)
    thr = j.groupBy(key).agg(F.sqrt(F.greatest(F.min("v"), F.lit(0.0)) * F.greatest(F.percentile("v", 0.99), F.lit(0.0))).alias("thr"))
    x = j.withColumn("before", F.lag("v").over(Window.partitionBy(key).orderBy("t", "series_id", "frame_idx"))).join(thr, key)
    up = (F.col("before") < F.col("thr")) & (F.col("v") >= F.col("thr")) & (F.col("t") <= F.col("mid"))
    down = (F.col("before") >= F.col("thr")) & (F.col("v") < F.col("thr")) & (F.col("t") >= F.col("mid"))
    return x.groupBy(key).agg(F.max(F.when(up, F.col("t"))).alias("onset"), F.min(F.when(down, F.col("t"))).alias("offset"))


def sounding_sides(points: DataFrame, notes: DataFrame, keys: Sequence[str], key: str, margin: float) -> DataFrame:
    """Bounds of the sound of notes (points: keys, channel, t, v; the first channel in alphabetical order that has points counts).

    sound_start: the last rise before the middle of the note above the geometric mean of its least value up to there and its
    99th percentile; sound_end: the first fall after it below that of its least value after sound_start; the note's own bounds
    where there are none.
    """
    wide = notes.select(*keys, key, F.col("start").alias("note_start"), F.col("end").alias("note_end"), (F.col("start") - margin).alias("start"), (F.col("end") + margin).alias("end"))
    j = intervals.interval_join(points, wide, keys)
    first = F.min("channel").over(Window.partitionBy(key))
    mid = (F.col("note_start") + F.col("note_end")) / 2
    x = j.withColumn("first", first).filter("channel = first").withColumn("mid", mid)
    x = x.withColumn("before", F.lag("v").over(Window.partitionBy(key).orderBy("t")))
    w = Window.partitionBy(key)
    inside = F.col("t").between(F.col("note_start"), F.col("note_end"))
    x = x.withColumn("top", F.percentile(F.when(inside, F.col("v")), 0.99).over(w)).withColumn("low", F.min(F.when(F.col("t") <= F.col("mid"), F.col("v"))).over(w))
    edge = lambda low: F.sqrt(F.greatest(F.col(low), F.lit(0.0)) * F.greatest(F.col("top"), F.lit(0.0)))
    rise = (F.col("before") < edge("low")) & (F.col("v") >= edge("low")) & (F.col("t") <= F.col("mid"))
    x = x.withColumn("onset", F.coalesce(F.max(F.when(rise, F.col("t"))).over(w), "note_start"))
    x = x.withColumn("low2", F.min(F.when(F.col("t") >= F.col("onset"), F.col("v"))).over(w))
    fall = (F.col("before") >= edge("low2")) & (F.col("v") < edge("low2")) & (F.col("t") >= F.col("mid"))
    g = x.groupBy(key).agg(F.first("first").alias("channel"), F.first("onset").alias("sound_start"), F.min(F.when(fall, F.col("t"))).alias("fall"), F.first("note_end").alias("note_end"))
    return g.select(key, "channel", "sound_start", F.coalesce("fall", "note_end").alias("sound_end"))
