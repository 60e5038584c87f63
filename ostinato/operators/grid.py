"""Irregular readings onto a regular grid.

Cell k of a series spans [t0+(k-1/2)dt, t0+(k+1/2)dt), 0 <= k < n_slots. Readings are hashed by series
and block of cells, so that a series of any length is worked on in many tasks; a marker row for each
block, made from the header, closes the block and stands for blocks without any reading.

Consecutive readings of a block are differenced: the cells strictly between two of them are uncovered.
In counter mode the increment of each pair (from zero after a reset) is shared among the cells in
proportion to overlap; intervals longer than max_gap cells are marked, not shared.

Nulls: readings whose t or v is null or NaN, or whose series has no header, don't count. Headers with
a null t0, dt or n_slots, dt <= 0 or n_slots < 1 have no cells. Copies of a reading (same series_id and
frame_idx) count once. No readings: every cell is a gap. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ostinato.session import broadcast_if_small, present

BLOCK = 4096
#: Added to the cell that ends a block, to tell it from a cell with readings.
SENTINEL = 1 << 40


def _headers(series: DataFrame) -> DataFrame:
    return series.select("series_id", "t0", "dt", F.col("n_slots").cast("long").alias("n_slots")).filter(
        "series_id IS NOT NULL AND n_slots >= 1 AND dt > 0 AND NOT isnan(dt) AND t0 IS NOT NULL AND NOT isnan(t0)"
    )


def _placed(readings: DataFrame, headers: DataFrame, margin: int = 0) -> DataFrame:
    """Readings with pos, their place in cell units; those more than margin cells outside the series are left out."""
    pos = (F.col("t") - F.col("t0")) / F.col("dt") + F.lit(0.5)
    return (
        readings.select("series_id", "frame_idx", F.col("t").cast("double").alias("t"), F.col("v").cast("double").alias("v"))
        .filter(present("t") & present("v"))
        .join(broadcast_if_small(headers), "series_id")
        .withColumn("pos", pos)
        .filter((F.col("pos") >= -margin) & (F.col("pos") < F.col("n_slots") + margin))
        .withColumn("cell", F.floor("pos"))
    )


def _markers(headers: DataFrame, block: int) -> DataFrame:
    """One row for each block of each series: cell is the first cell past the block."""
    n_blocks = F.floor((F.col("n_slots") - 1) / block)
    return headers.select("series_id", "n_slots", F.explode(F.sequence(F.lit(0).cast("long"), n_blocks)).alias("block")).select(
        "series_id", "block", F.least(F.col("n_slots"), (F.col("block") + 1) * block).alias("cell")
    )


def uncovered_intervals(readings: DataFrame, series: DataFrame, block: int = BLOCK) -> DataFrame:
    """Maximal runs of cells, within a block, that no reading falls into: series_id, first, last.

    A run that crosses the edge of a block comes out as one interval on either side.
    """
    headers = _headers(series)
    seen = _placed(readings, headers).select("series_id", F.floor(F.col("cell") / block).alias("block"), "cell")
    both = seen.unionByName(_markers(headers, block))
    w = Window.partitionBy("series_id", "block").orderBy("cell")
    before = F.lag("cell").over(w)
    return (
        both.withColumn("first", F.coalesce(before, F.col("block") * block - 1) + 1)
        .select("series_id", "first", (F.col("cell") - 1).alias("last"))
        .filter("first <= last")
    )


def uncovered_slots(readings: DataFrame, series: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row for each cell without a reading: series_id, slot."""
    return uncovered_intervals(readings, series, block).select(
        "series_id", F.explode(F.sequence(F.col("first").cast("int"), F.col("last").cast("int"))).alias("slot")
    )


def level_grid(readings: DataFrame, series: DataFrame, block: int = BLOCK) -> DataFrame:
    """Levels: one row for each cell of each series: series_id, slot, t, v, n_readings, is_gap.

    v is the mean of the readings in the cell, null in a gap; t is the time of the grid.
    """
    headers = _headers(series)
    seen = _placed(readings, headers).select("series_id", F.floor(F.col("cell") / block).alias("block"), "cell", "frame_idx", "v", F.lit(False).alias("is_end"))
    ends = _markers(headers, block).select("series_id", "block", "cell", F.lit(None).cast(seen.schema["frame_idx"].dataType).alias("frame_idx"), F.lit(None).cast("double").alias("v"), F.lit(True).alias("is_end"))
    # The only shuffle of the readings: all that follows keeps them by series and block.
    once = seen.unionByName(ends).repartition("series_id", "block").groupBy("series_id", "block", "cell", "is_end", "frame_idx").agg(F.first("v").alias("v"))
    cells = once.groupBy("series_id", "block", "cell", "is_end").agg(F.avg("v").alias("v"), F.count("v").alias("n_readings"))
    start = F.coalesce(F.lag("cell").over(Window.partitionBy("series_id", "block").orderBy("cell")), F.col("block") * block - 1) + 1
    # Each cell with the empty ones before it; the end of a block stands for those at its end only.
    last = F.when(F.col("is_end"), F.col("cell") - 1).otherwise(F.col("cell"))
    spread = cells.withColumn("start", start).withColumn("last", last).filter("start <= last").withColumn("slot", F.explode(F.sequence("start", "last")))
    own = (F.col("slot") == F.col("cell")) & ~F.col("is_end")
    return spread.join(broadcast_if_small(headers), "series_id").select(
        "series_id",
        F.col("slot").cast("int").alias("slot"),
        (F.col("t0") + F.col("slot") * F.col("dt")).alias("t"),
        F.when(own, F.col("v")).alias("v"),
        F.when(own, F.col("n_readings")).otherwise(F.lit(0)).cast("long").alias("n_readings"),
        (~own).alias("is_gap"),
    )


def counter_grid(readings: DataFrame, series: DataFrame, max_gap: float = 8.0, block: int = BLOCK) -> DataFrame:
    """Cumulative counters: one row for each cell: series_id, slot, increment, n_resets, covered (share of the cell, 0 to 1).

    A reading below the one before it is a reset: its own value is what was counted since. Of readings at the
    same time, frame_idx decides the order. Intervals of more than max_gap cells leave their cells uncovered.
    """
    headers = _headers(series)
    r = _placed(readings, headers, margin=int(max_gap) + 1).select("series_id", F.floor(F.col("cell") / block).alias("block"), F.lit(False).alias("is_end"), "frame_idx", "pos", "v", "n_slots")
    ends = _markers(headers, block).select(
        "series_id", "block", F.lit(True).alias("is_end"), F.lit(None).cast(r.schema["frame_idx"].dataType).alias("frame_idx"), F.col("cell").cast("double").alias("pos"), F.lit(None).cast("double").alias("v"), F.lit(None).cast("long").alias("n_slots")
    )
    # The only shuffle of the readings: all that follows keeps them by series and block.
    rows = (
        r.unionByName(ends)
        .repartition("series_id", "block")
        .groupBy("series_id", "block", "is_end", "frame_idx")
        .agg(F.first("pos").alias("pos"), F.first("v").alias("v"))
    )
    mine = F.when(~F.col("is_end"), F.struct("pos", "frame_idx", "v"))
    # What lies across the edges of a block: the last reading before it and the first one after it.
    by_block = Window.partitionBy("series_id").orderBy("block")
    edges = rows.groupBy("series_id", "block").agg(F.min(mine).alias("first"), F.max(mine).alias("last")).select(
        "series_id",
        "block",
        F.last("last", ignorenulls=True).over(by_block.rowsBetween(Window.unboundedPreceding, -1)).alias("prior"),
        F.first("first", ignorenulls=True).over(by_block.rowsBetween(1, Window.unboundedFollowing)).alias("next"),
    )
    w = Window.partitionBy("series_id", "block").orderBy("is_end", "pos", "frame_idx")
    x = rows.withColumn("lag", F.lag(mine).over(w)).join(edges, ["series_id", "block"])
    # A reading closes the interval from the one before it; the end of a block opens the one to the next block's first reading.
    x = x.select(
        "series_id", "block", "is_end", F.col("pos").alias("at"),
        F.coalesce("lag", "prior").alias("a"),
        F.when(F.col("is_end"), F.col("next")).otherwise(F.struct("pos", "frame_idx", "v")).alias("b"),
    )
    a, b, cell = F.col("a.pos"), F.col("b.pos"), F.col("cell")
    shared = F.col("a").isNotNull() & F.col("b").isNotNull() & (b - a <= max_gap)
    first, last = F.greatest(F.floor(a), F.col("block") * block), F.least(F.floor(b), (F.col("block") + 1) * block - 1)
    none = F.array().cast("array<bigint>")
    cells = F.when(shared & (first <= last), F.sequence(first, last)).otherwise(none)
    end = F.when(F.col("is_end"), F.array(F.col("at").cast("long") + F.lit(SENTINEL))).otherwise(none)
    size = F.when(b > a, F.least(b, cell + 1) - F.greatest(a, cell)).otherwise(0.0)
    share = F.when(b > a, size / (b - a)).otherwise(1.0)
    reset = F.col("b.v") < F.col("a.v")
    real = cell < SENTINEL
    parts = x.withColumn("cell", F.explode(F.concat(cells, end))).select(
        "series_id", "block",
        F.when(real, cell).otherwise(cell - SENTINEL).alias("cell"),
        F.when(real, F.when(reset, F.col("b.v")).otherwise(F.col("b.v") - F.col("a.v")) * share).alias("increment"),
        (real & reset & (cell == F.floor(b)) & ~F.col("is_end")).cast("int").alias("reset"),
        F.when(real, size).otherwise(0.0).alias("covered"),
        (~real).alias("is_end"),
    )
    summed = parts.groupBy("series_id", "block", "cell", "is_end").agg(F.sum("increment").alias("increment"), F.sum("reset").alias("n_resets"), F.least(F.sum("covered"), F.lit(1.0)).alias("covered"))
    # Cells between those that hold anything, and up to the end of the block, are uncovered.
    in_block = Window.partitionBy("series_id", "block").orderBy("cell", "is_end")
    up_to = F.max(F.when(F.col("is_end"), cell)).over(Window.partitionBy("series_id", "block"))
    start = F.greatest(F.coalesce(F.lag("cell").over(in_block), F.col("block") * block - 1) + 1, F.lit(0))
    y = summed.select("*", start.alias("start"), up_to.alias("up_to")).filter((cell <= F.col("up_to")) & (F.col("start") <= cell))
    y = y.withColumn("slot", F.explode(F.sequence("start", "cell"))).filter(F.col("slot") < F.col("up_to"))
    own = (F.col("slot") == cell) & ~F.col("is_end")
    return y.select(
        "series_id",
        F.col("slot").cast("int").alias("slot"),
        F.when(own, F.col("increment")).alias("increment"),
        F.when(own, F.col("n_resets")).otherwise(0).cast("long").alias("n_resets"),
        F.when(own, F.col("covered")).otherwise(0.0).alias("covered"),
    )
