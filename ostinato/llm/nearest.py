"""Matching records by nearest time within a tolerance.

Times of an entity are cut into shards of SHARD_SECONDS; a shard with more than HOT records on either side is
halved until none has more (FINEST times at most, as records at one time can't be told apart). Shards overlap by
a record at each edge: each holds the last record of the right side before it and the first after it, however far
away, so that no pair is lost. What is still hot on the left is salted, the right side being copied to each salt.
Shards are hashed into buckets. In a bucket the right times are sorted and modelled by a piecewise-linear index,
whose pieces predict a position with an error of at most ERROR; a search of that many places around the
prediction gives the exact neighbours.

Null entities, null or NaN times and null ids match nothing. Copies (same id, entity and time) count once;
of right records at the same time the smallest id is taken. Of two equally near times the earlier one is
taken. Each left record gives at most one row for each entity it belongs to. Extra columns are left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ostinato.operators.sync import best_delays
from ostinato.session import broadcast_if_small, checkpointed, parts_for, path_key, present

SHARD_SECONDS = 64.0
HOT = 50_000
FINEST = 20
ROWS_A_BUCKET = 50_000
ERROR = 8
#: Sums of decimal fractions differ from the true ones by less than this.
ROUNDING = 1e-9
_ROWS = pa.schema([("left_id", pa.int64()), ("right_id", pa.int64()), ("gap", pa.float64())])


def pieces(keys: np.ndarray, error: int = ERROR) -> tuple[np.ndarray, np.ndarray]:
    """First position and slope of the pieces of an index on ascending keys, each off by at most `error`.

    A piece goes on as long as the slopes that keep all its keys within the error have something in common; it is
    looked for in stretches that double.
    """
    first, slopes = [], []
    start, n = 0, len(keys)
    while start < n:
        reach, low, high, end = 64, -np.inf, np.inf, start + 1
        while end < n:
            stop = min(start + reach, n)
            run, rise = keys[end:stop] - keys[start], np.arange(end - start, stop - start)
            with np.errstate(divide="ignore", invalid="ignore"):
                lows = np.where(run > 0, (rise - error) / run, np.where(rise <= error, -np.inf, np.inf))
                highs = np.where(run > 0, (rise + error) / run, np.where(rise <= error, np.inf, -np.inf))
            lows, highs = np.maximum(np.maximum.accumulate(lows), low), np.minimum(np.minimum.accumulate(highs), high)
            bad = np.flatnonzero(lows > highs)
            held = int(bad[0]) if len(bad) else len(lows)
            if held:
                low, high = float(lows[held - 1]), float(highs[held - 1])
            end += held
            if len(bad):
                break
            reach *= 2
        first.append(start)
        slopes.append((low + high) / 2 if np.isfinite(low + high) else 0.0)
        start = end
    return np.array(first, dtype=np.int64), np.array(slopes)


def positions(keys: np.ndarray, first: np.ndarray, slopes: np.ndarray, asked: np.ndarray, error: int = ERROR) -> np.ndarray:
    """How many keys are at most each asked value."""
    piece = np.maximum(np.searchsorted(keys[first], asked, side="right") - 1, 0)
    ends = np.append(first[1:], len(keys))
    guess = first[piece] + slopes[piece] * (asked - keys[first[piece]])
    guess = np.clip(guess, first[piece], ends[piece]).astype(np.int64)
    lo = np.maximum(guess - error - 1, first[piece])
    around = lo[:, None] + np.arange(2 * error + 4)[None, :]
    held = around < ends[piece][:, None]
    count = (held & (keys[np.minimum(around, len(keys) - 1)] <= asked[:, None])).sum(axis=1)
    return np.where(asked < keys[0], 0, lo + count)


def _match_bucket(tolerance: float):
    def match(data: pa.Table) -> pa.Table:
        g = data.to_pandas()
        if g["side"].nunique() < 2:
            return _ROWS.empty_table()
        # Arrow compares whole strings; pandas would end them at a NUL.
        codes = data.column("place").combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
        g = g.assign(code=codes)
        # One key for place and time: places don't overlap, times count from the first of the bucket.
        t = g["t"].to_numpy()
        key = codes * (t.max() - t.min() + 1.0) + (t - t.min())
        is_left = (g["side"] == 0).to_numpy()
        rt, rid, rkey, rcode = (x[~is_left] for x in (g["t"].to_numpy(), g["id"].to_numpy(), key, codes))
        by = np.lexsort((rid, rt, rcode))
        rt, rid, rkey, rcode = rt[by], rid[by], rkey[by], rcode[by]
        lt, lid, lkey, lcode = (x[is_left] for x in (g["t"].to_numpy(), g["id"].to_numpy(), key, codes))
        at = positions(rkey, *pieces(rkey), lkey)
        best = np.full(len(lt), np.inf)
        chosen = np.full(len(lt), -1)
        for step in (-2, -1, 0, 1):  # from the earliest: an equally near later one doesn't replace it
            i = np.clip(at + step, 0, len(rt) - 1)
            gap = np.where(rcode[i] == lcode, np.abs(rt[i] - lt), np.inf)
            nearer = gap < best - ROUNDING
            best, chosen = np.where(nearer, gap, best), np.where(nearer, i, chosen)
        ok = best <= tolerance + ROUNDING
        return pa.table({"left_id": lid[ok], "right_id": rid[chosen[ok]], "gap": best[ok]}, schema=_ROWS)

    return match


def _sharded(df: DataFrame, hot: DataFrame, name: str = "shard") -> DataFrame:
    """df with the shard of each record: the start of its stretch of time; hot: entity, coarse, halvings."""
    x = df.withColumn("coarse", F.floor(F.col("t") / SHARD_SECONDS)).join(hot, ["entity", "coarse"], "left")
    width = F.lit(SHARD_SECONDS) / F.pow(F.lit(2.0), F.coalesce("halvings", F.lit(0)))
    return x.withColumn(name, F.floor(F.col("t") / width) * width).drop("coarse", "halvings")


def nearest_in_time(left: DataFrame, right: DataFrame, tolerance: float) -> DataFrame:
    """Pairs left_id, right_id, gap of the records (entity, t, id) of two tables; t in seconds.

    Both sides are written once, as they are read for the counts, the edges and the match.
    """
    usable = F.col("entity").isNotNull() & present("t") & F.col("id").isNotNull() & (F.abs("t") < 1e15)
    narrow = ["entity", F.col("t").cast("double").alias("t"), F.col("id").cast("long").alias("id")]
    asked = left.select(*narrow).filter(usable).distinct().select(F.lit(0).alias("side"), "entity", "t", "id")
    held = right.select(*narrow).filter(usable).groupBy("entity", "t").agg(F.min("id").alias("id")).select(F.lit(1).alias("side"), "entity", "t", "id")
    both = checkpointed(asked.unionByName(held))
    counts = both.groupBy("entity", F.floor(F.col("t") / SHARD_SECONDS).alias("coarse"), "side").agg(F.count("*").alias("n"))
    hot = counts.groupBy("entity", "coarse").agg(F.max("n").alias("n")).filter(F.col("n") > HOT)
    # Halved until an even shard would hold a quarter of HOT, so that uneven ones rarely pass it.
    halvings = F.least(F.ceil(F.log2(F.col("n") / HOT)) + 2, F.lit(FINEST)).cast("int")
    both = _sharded(both, broadcast_if_small(hot.select("entity", "coarse", halvings.alias("halvings"))))
    # One row for each shard: its first and last record on the right, and how many there are on the left.
    is_right = F.col("side") == 1
    shards = both.groupBy("entity", "shard").agg(
        F.min(F.when(is_right, F.struct("t", "id"))).alias("first"), F.max(F.when(is_right, F.struct("t", "id"))).alias("last"), F.count_if(~is_right).alias("n_left"), F.count("*").alias("n")
    )
    by_time = Window.partitionBy("entity").orderBy("shard")
    shards = checkpointed(
        shards.select(
            "entity", "shard", "n_left", "n", F.greatest(F.ceil(F.col("n_left") / HOT), F.lit(1)).alias("salts"),
            F.last("last", ignorenulls=True).over(by_time.rowsBetween(Window.unboundedPreceding, -1)).alias("prior"),
            F.first("first", ignorenulls=True).over(by_time.rowsBetween(1, Window.unboundedFollowing)).alias("next"),
        ).filter("n_left > 0")
    )
    edges = shards.select("entity", "shard", F.explode(F.array_compact(F.array("prior", "next"))).alias("r"), "salts").select(F.lit(1).alias("side"), "entity", "r.t", "r.id", "shard", "salts")
    salts = broadcast_if_small(shards.filter("salts > 1").select("entity", "shard", "salts"))
    rows = both.join(salts, ["entity", "shard"], "left").select("side", "entity", "t", "id", "shard", F.coalesce("salts", F.lit(1).cast("long")).alias("salts"))
    rows = rows.unionByName(edges)
    every = F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)
    rows = rows.withColumn("salt", F.explode(F.when(F.col("side") == 0, F.array(F.pmod(F.xxhash64("id", "t"), F.col("salts")))).otherwise(every)))
    columns = ["side", "t", "id", F.concat_ws("\x1f", "entity", F.col("shard").cast("string"), "salt").alias("place"), F.xxhash64("entity", "shard", "salt").alias("hash")]
    total = shards.agg(F.sum("n")).first()[0] or 0
    buckets = parts_for(total, ROWS_A_BUCKET)
    return rows.select(*columns).withColumn("bucket", F.pmod("hash", F.lit(buckets))).groupBy("bucket").applyInArrow(_match_bucket(tolerance), "left_id long, right_id long, gap double")


def marks_to_notes(marks: DataFrame, delays: DataFrame, notes: DataFrame, tolerance: float = 0.150) -> DataFrame:
    """Note nearest to each video mark, for each signal file its video covers: mark_id, note_key, gap in seconds."""
    seen = marks.select("mark_id", path_key("video_file").alias("video"), "msec").filter(present("msec")).distinct()
    clock = seen.join(broadcast_if_small(best_delays(delays)), "video")
    left = clock.select(F.col("signal").alias("entity"), (F.col("msec") / 1000 + F.col("delay")).alias("t"), F.col("mark_id").alias("id"))
    right = notes.select(path_key("wavfile").alias("entity"), F.col("note_start").alias("t"), F.col("note_key").alias("id"))
    return nearest_in_time(left, right, tolerance).select(F.col("left_id").alias("mark_id"), F.col("right_id").alias("note_key"), "gap")
