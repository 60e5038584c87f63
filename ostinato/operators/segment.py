"""Segmentation of a recording into notes, attacks and releases."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ostinato.operators import blocks, intervals
from ostinato.operators.grouped import per_group
from ostinato.operators.sequences import greedy_pairs
from ostinato.operators.signals import find_peaks


def median_filtered(x: np.ndarray, size: int) -> np.ndarray:
    """Median over `size` (odd) values around each, zeros beyond the ends."""
    half = size // 2
    return np.median(np.lib.stride_tricks.sliding_window_view(np.concatenate([np.zeros(half), x, np.zeros(half)]), size), axis=1)


def levels(ampl: np.ndarray) -> tuple[float, float]:
    """Typical values of silence and voice: medians on either side of the geometric mean of the 1st and 99th percentile."""
    if not len(ampl):
        return 0.0, 0.0
    lo, hi = np.percentile(ampl, [1, 99])
    edge = np.sqrt(max(lo, 0.0) * max(hi, 0.0))
    low, high = ampl[ampl <= edge], ampl[ampl > edge]
    return float(np.median(low)) if len(low) else 0.0, float(np.median(high)) if len(high) else float(edge)


def boundaries(t: np.ndarray, f0: np.ndarray, ampl: np.ndarray, window: float = 0.1, prominence: float = 3.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Boundaries of notes: places where they end and begin (equal unless a dip and a jump are matched), and smoothed pitch.

    Dips of the level by at least `prominence` dB are matched with jumps of the smoothed, rounded pitch.
    """
    db = 20 * np.log10(np.maximum(ampl, 1e-9))
    with np.errstate(all="ignore"):
        pitch = np.where(f0 > 0, np.rint(12 * np.log2(np.where(f0 > 0, f0, 1) / 440)), -100)
    step = np.median(np.diff(t)) if len(t) > 1 else window
    size = int(2 * round(window / max(step, 1e-6) / 2) + 1)
    smooth = median_filtered(pitch, size)
    silence, voice = levels(ampl)
    dips = find_peaks(-db, prominence=prominence, height=-20 * np.log10(max(100 * voice, 1e-9)), most=-20 * np.log10(max(0.01 * silence, 1e-9)))
    jumps = np.flatnonzero(np.diff(smooth) != 0)
    pairs = greedy_pairs(dips.astype(float), jumps.astype(float), float(size))
    met_d, met_j = {i for i, _ in pairs}, {j for _, j in pairs}
    places = [(min(dips[i], jumps[j]), max(dips[i], jumps[j])) for i, j in pairs]
    places += [(p, p) for i, p in enumerate(dips) if i not in met_d] + [(p, p) for j, p in enumerate(jumps) if j not in met_j]
    places.sort(key=lambda p: p[0] + p[1])
    return np.array([p[0] for p in places], dtype=int), np.array([p[1] for p in places], dtype=int), smooth


_STATS = ["start", "end", "round_pitch", "mean_pitch", "median_pitch", "std_pitch", "iqr_pitch", "mean_db", "std_db"]


def notes_of(t: np.ndarray, f0: np.ndarray, ampl: np.ndarray, window: float = 0.1) -> pd.DataFrame:
    """Notes between boundaries that last longer than `window`, have a pitch and are louder than silence, with their statistics."""
    ends, begins, smooth = boundaries(t, f0, ampl, window)
    silence, voice = levels(ampl)
    edge = 10 * np.log10(max(silence, 1e-9) * max(voice, 1e-9))
    with np.errstate(all="ignore"):
        pitch = np.where(f0 > 0, 12 * np.log2(np.where(f0 > 0, f0, 1) / 440), np.nan)
    db = 20 * np.log10(np.maximum(ampl, 1e-9))
    out = []
    for a, b in zip(begins[:-1], ends[1:], strict=True):
        heard = pitch[a:b][~np.isnan(pitch[a:b])]
        if b - a < 1 or not len(heard):
            continue
        q = np.percentile(heard, [25, 50, 75])
        row = (t[a], t[b], float(np.median(smooth[a:b])), float(heard.mean()), q[1], float(heard.std()), q[2] - q[0], float(db[a:b].mean()), float(db[a:b].std()))
        if row[1] - row[0] > window and row[2] > -99 and row[7] > edge:
            out.append(row)
    return pd.DataFrame(out, columns=_STATS)


def segment_series(df: DataFrame, keys: list[str], window: float = 0.1) -> DataFrame:
    """Notes of each group of rows (keys, t, f0, ampl)."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("t", kind="stable")
        n = notes_of(g["t"].to_numpy(), g["f0"].fillna(0).to_numpy(), g["ampl"].fillna(0).to_numpy(), window)
        n.insert(0, "note_nbr", np.arange(1, len(n) + 1))
        return n

    return per_group(df, keys, run, "note_nbr long, " + ", ".join(f"{c} double" for c in _STATS))


#: Tilts in dB a second by which the lowest point, the corner of an attack and that of a release are told.
SLOW, ATTACK, RELEASE = 4.0, 40.0, 80.0


def attacks(points: DataFrame, notes: DataFrame, keys: list[str], reach: float = 10.0, slow: float = SLOW, attack: float = ATTACK, release: float = RELEASE) -> DataFrame:
    """Attacks and releases of notes (keys, note_key, start, end) in the level of points (keys, t, v; one for each t).

    top_t: where a note is loudest. On the way there from the loudest place of the note before (at most `reach` seconds), the
    attack starts at the minimum of the level tilted by `slow`, and its corner is the maximum of the level tilted by `attack`.
    The release ends at the minimum tilted the other way, on the way to the next note's loudest place; its corner is the maximum
    tilted by `release` before. prev_local_min and next_local_min: the dip nearest to the note's start, or end; next_dip: that,
    or the end of the release. max_slope and median_slope: of the attack, in dB a second. Notes without points give no rows.
    """
    p = points.select(*keys, "t", (20 * F.log10(F.greatest("v", F.lit(1e-9)))).alias("db"))
    inside = intervals.interval_join(p, notes.select(*keys, "note_key", "start", "end"), keys)
    tops = inside.groupBy(*keys, "note_key", "start", "end").agg((-F.max(F.struct("db", (-F.col("t")).alias("t")))["t"]).alias("top_t"))
    tops = blocks.parted(tops, "start", blocks.SECONDS)
    tops = blocks.neighbour(tops, keys, ["start", "note_key"], F.struct("top_t"), "__a")
    tops = blocks.tidy(blocks.neighbour(tops, keys, ["start", "note_key"], F.struct("top_t"), "__b", after=True))
    top, t, db = F.col("top_t"), F.col("t"), F.col("db")
    spans = tops.select(
        *keys, "note_key", "top_t", F.col("start").alias("note_start"), F.col("end").alias("note_end"),
        F.least(top, F.greatest(F.coalesce("__a.top_t", F.lit(-1e300)), top - reach)).alias("start"),
        F.greatest(top, F.least(F.coalesce("__b.top_t", F.lit(1e300)), top + reach)).alias("end"),
    )
    w = Window.partitionBy("note_key")
    order = w.orderBy("t")
    x = intervals.interval_join(p, spans, keys).select("note_key", "top_t", "note_start", "note_end", "t", "db", F.lag("db").over(order).alias("db1"), F.lead("db").over(order).alias("db2"), F.lag("t").over(order).alias("t1"))
    pick = lambda f, when, tilt, sign: f(F.when(when, F.struct(tilt.alias("x"), (sign * t).alias("t")))).over(w)["t"] * sign
    dip = (db < F.col("db1")) & (db < F.col("db2"))
    x = x.withColumns(
        {
            "attack_start": pick(F.min, t <= top, db - slow * t, 1), "release_end": pick(F.min, t >= top, db + slow * t, 1),
            "prev_local_min": pick(F.min, dip & (t < top), F.abs(t - F.col("note_start")), 1), "next_local_min": pick(F.min, dip & (t > top), F.abs(t - F.col("note_end")), 1),
        }
    )
    x = x.withColumns(
        {"attack_corner": pick(F.max, (t >= F.col("attack_start")) & (t <= top), db - attack * t, -1), "release_corner": pick(F.max, (t >= top) & (t <= F.col("release_end")), db + release * t, -1)}
    )
    rising = (F.col("t1") >= F.col("attack_start")) & (t <= F.col("attack_corner"))
    slope = F.when(rising, (db - F.col("db1")) / F.nullif(t - F.col("t1"), F.lit(0.0)))
    level = lambda c: F.max(F.when(t == F.col(c), db))
    same = ["top_t", "attack_start", "attack_corner", "release_corner", "release_end", "prev_local_min", "next_local_min"]
    g = x.groupBy("note_key", *same).agg((level("attack_corner") - level("attack_start")).alias("attack_db"), F.max(slope).alias("max_slope"), F.percentile(slope, 0.5).alias("median_slope"))
    return g.withColumn("next_dip", F.coalesce("next_local_min", "release_end"))
