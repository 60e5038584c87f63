"""Detections in video frames: smoothing, centres, distances, cutting to recordings."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ostinato.functions.exprs import col
from ostinato.operators import blocks
from ostinato.operators.grouped import per_group, streamed
from ostinato.session import present

LISTED = 1024  # points of which all pairs are listed


#: Variance and covariance of an observed position; of the process variance and covariance of position,
#: of velocity, and covariance of position with velocity along the same axis and along the other.
OBSERVED = (0.05, 0.001)
PROCESS = {"position": (0.15, 0.015), "velocity": (0.25, 0.05), "same_axis": 0.1, "other_axis": 0.025}


def kalman_smooth(z: np.ndarray, observation=OBSERVED, process=PROCESS, calm: float = 1.0) -> np.ndarray:
    """Positions (tracks, time, 2) of points moving at near constant velocity, smoothed forwards and backwards; NaN is missing.

    observation and process: as OBSERVED and PROCESS, the latter divided by `calm`.
    All tracks go through a step together; missing positions at the end of shorter ones change nothing. A track
    without any position stays NaN.
    """
    seen = ~np.isnan(z).any(axis=2)
    tracks, n = seen.shape
    x = np.where(seen[:, :, None], z, 0.0)
    count = seen.sum(axis=1)
    (a, b), (c, d), e, f = process["position"], process["velocity"], process["same_axis"], process["other_axis"]
    move = np.array([[1, 0, 1, 0], [0, 1, 0, 1], [0, 0, 1, 0], [0, 0, 0, 1]], dtype=float)
    q = np.array([[a, b, e, f], [b, a, f, e], [e, f, c, d], [f, e, d, c]]) / calm
    r = np.array([[observation[0], observation[1]], [observation[1], observation[0]]])
    m = np.zeros((tracks, 4))
    m[:, :2] = x.sum(axis=1) / np.maximum(count, 1)[:, None]
    p = np.broadcast_to(np.eye(4), (tracks, 4, 4)).copy()
    before_m, before_p = np.zeros((n, tracks, 4)), np.zeros((n, tracks, 4, 4))
    after_m, after_p = np.zeros((n, tracks, 4)), np.zeros((n, tracks, 4, 4))
    for i in range(n):
        if i:
            m, p = m @ move.T, move @ p @ move.T + q
        before_m[i], before_p[i] = m, p
        here = seen[:, i]
        gain = p[:, :, :2] @ np.linalg.inv(p[:, :2, :2] + r) * here[:, None, None]
        m = m + (gain @ (x[:, i] - m[:, :2])[:, :, None])[:, :, 0]
        p = p - gain @ p[:, :2, :]
        after_m[i], after_p[i] = m, p
    out = after_m.copy()
    for i in range(n - 2, -1, -1):
        back = after_p[i] @ move.T @ np.linalg.inv(before_p[i + 1])
        out[i] = after_m[i] + (back @ (out[i + 1] - before_m[i + 1])[:, :, None])[:, :, 0]
    return np.where((count > 0)[:, None, None], out.transpose(1, 0, 2)[:, :, :2], np.nan)


def forward_step(m: np.ndarray | None, p: np.ndarray | None, seen: np.ndarray | None, observation=OBSERVED, process=PROCESS) -> tuple[np.ndarray, np.ndarray]:
    """Mean (x, y and their velocities) and covariance of a point after one more frame; m: None before the first one, seen: None if it wasn't."""
    (a, b), (c, d), e, f = process["position"], process["velocity"], process["same_axis"], process["other_axis"]
    if m is None:
        m, p = np.array([*seen, 0.0, 0.0]), np.eye(4)
    else:
        move = np.eye(4) + np.eye(4, k=2)
        m, p = move @ m, move @ p @ move.T + np.array([[a, b, e, f], [b, a, f, e], [e, f, c, d], [f, e, d, c]])
    if seen is not None:
        (u, w) = observation
        gain = p[:, :2] @ np.linalg.inv(p[:2, :2] + np.array([[u, w], [w, u]]))
        m, p = m + gain @ (seen - m[:2]), p - gain @ p[:2]
    return m, p


def smooth_tracks(z: np.ndarray, far: float = 50.0) -> tuple[np.ndarray, np.ndarray]:
    """Smoothed tracks without outliers, and which positions those are: more than `far` from a very calm track."""
    out = np.sqrt(((z - kalman_smooth(z, calm=1e5)) ** 2).sum(axis=2)) > far
    return kalman_smooth(np.where(out[:, :, None], np.nan, z)), out


#: Rows of a track that are smoothed at a time, and how many more on either side: what lies farther away has no weight left.
TRACK_ROWS, TRACK_HALO = 8192, 1024


def smooth_marks(marks: DataFrame, keys: list[str], order: str, key: str, together: int = 256) -> DataFrame:
    """Tracks (keys, order, key, x, y) smoothed: keys, key, smooth_x, smooth_y, is_outlier.

    A track longer than TRACK_ROWS is smoothed in parts that overlap: only its first rows, which are drawn to the mean of
    their part, come out otherwise than of the whole track. Rows without a key, time or place in order are none.
    """
    types = {f.name: f.dataType.simpleString() for f in marks.schema.fields}
    schema = ", ".join([*(f"`{k}` {types[k]}" for k in keys), f"`{key}` {types[key]}", "smooth_x double, smooth_y double, is_outlier boolean"])
    rows = blocks.numbered(marks.select(*keys, order, key, "x", "y").filter(F.col(order).isNotNull()), keys, [order, key], blocks.SECONDS * 1000, "__pos")
    rows = blocks.tidy(rows.withColumn("__at", F.col("__pos")))
    own, rest = F.floor(F.col("__at") / TRACK_ROWS), F.col("__at") % TRACK_ROWS
    before, after = F.when((rest < TRACK_HALO) & (own > 0), own - 1), F.when(rest >= TRACK_ROWS - TRACK_HALO, own + 1)
    rows = rows.withColumn("__part", F.explode(F.array_compact(F.array(own, before, after)))).withColumn("__own", own == F.col("__part"))

    def run(g: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
        length = np.diff(np.append(starts, len(g)))
        track = np.repeat(np.arange(len(length)), length)
        place = np.arange(len(g)) - starts[track]
        xy, out = np.full((len(g), 2), np.nan), np.zeros(len(g), dtype=bool)
        by_length = np.argsort(length, kind="stable")
        turn = np.empty_like(by_length)
        turn[by_length] = np.arange(len(by_length))  # tracks of like length are smoothed together
        for lo in range(0, len(length), together):
            i = np.flatnonzero((turn[track] >= lo) & (turn[track] < lo + together))
            row = turn[track[i]] - lo
            z = np.full((row.max() + 1, place[i].max() + 1, 2), np.nan)
            z[row, place[i]] = g[["x", "y"]].to_numpy(dtype=float)[i]
            smooth, far = smooth_tracks(z)
            xy[i], out[i] = smooth[row, place[i]], far[row, place[i]]
        return g[[*keys, key]].assign(smooth_x=xy[:, 0], smooth_y=xy[:, 1], is_outlier=out)[g["__own"].to_numpy()]

    return streamed(rows, [*keys, "__part"], run, schema, ["__at"])


def _inversions(place: np.ndarray) -> int:
    """How many pairs of places (integers from 0) are in descending order; memory grows with their number, not with its square."""
    total, at = 0, np.arange(len(place))
    for b in reversed(range(int(place.max()).bit_length())):
        bit, above = (place >> b) & 1, place >> (b + 1)
        ones = np.cumsum(bit)
        new = np.append(True, above[1:] != above[:-1])
        first = np.maximum.accumulate(np.where(new, at, 0))
        total += int(((ones - ones[first] + bit[first]) * (1 - bit)).sum())
        place = place[np.argsort(place >> b, kind="stable")]
    return total


def _median_slope(t: np.ndarray, y: np.ndarray) -> float:
    """Median slope of all pairs with different t by bisection: slopes below s are pairs whose y - s * t descends over time."""
    by = np.lexsort((y, t))
    t, y = t[by] - t[by[0]], y[by]
    first = np.flatnonzero(np.append(True, t[1:] != t[:-1]))
    if len(first) == 1:
        return 0.0
    run, low, high = np.diff(t[first]), np.minimum.reduceat(y, first), np.maximum.reduceat(y, first)
    least, most = float(((low[1:] - high[:-1]) / run).min()), float(((high[1:] - low[:-1]) / run).max())
    held = np.diff(np.append(first, len(t)))
    pairs = (len(t) * (len(t) - 1) - int((held * (held - 1)).sum())) // 2

    def below(s: float) -> int:
        z = y - s * t
        # At equal times y ascends, and so does z.
        return _inversions(np.unique(z, return_inverse=True)[1])

    def ranked(k: int) -> float:
        spare = 1e-9 * max(abs(least), abs(most), 1e-300)
        lo, hi = least - spare, most + spare
        while lo < (mid := lo + (hi - lo) / 2) < hi and hi - lo > 1e-14 * max(abs(lo), abs(hi)) and hi - lo > 1e-16 * max(abs(least), abs(most)):
            lo, hi = (mid, hi) if below(mid) <= k else (lo, mid)
        # A pair with that slope has neighbouring z: its slope is free of the error of the sums.
        z = np.argsort(y - mid * t, kind="stable")
        dt, dy = np.diff(t[z]), np.diff(y[z])
        slopes = dy[dt != 0] / dt[dt != 0]
        return float(slopes[np.abs(slopes - mid).argmin()]) if np.abs(slopes - mid).min() <= 1e-12 * max(abs(least), abs(most)) else mid

    lower = ranked((pairs - 1) // 2)
    return lower if pairs % 2 else (lower + ranked(pairs // 2)) / 2


def robust_line(t: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept that half of the points agree with (Theil and Sen): median slope of pairs, median remainder.

    Beyond LISTED points the pairs are counted, not listed.
    """
    if len(t) == 0:
        return float("nan"), float("nan")
    if len(t) > LISTED:
        slope = _median_slope(t, y)
    else:
        i, j = np.triu_indices(len(t), 1)
        run = t[j] - t[i]
        slope = float(np.median((y[j] - y[i])[run != 0] / run[run != 0])) if (run != 0).any() else 0.0
    return slope, float(np.median(y - slope * t))


def robust_lines(df: DataFrame, keys: list[str], t: str, y: str) -> DataFrame:
    """keys, slope, intercept, n of the robust line of each group of rows."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        slope, intercept = robust_line(g[t].to_numpy(dtype=float), g[y].to_numpy(dtype=float))
        return pd.DataFrame({"slope": [slope], "intercept": [intercept], "n": [len(g)]})

    return per_group(df.select(*keys, t, y).filter(present(t) & present(y)), keys, run, "slope double, intercept double, n long")


def strip_length(area, short_side, scale_px, mm: float = 5.0):
    """Length in mm of a strip of known width: its area over its narrow side, by the scale's pixels for `mm`."""
    return col(area) / F.nullif(col(short_side), F.lit(0.0)) * mm / F.nullif(col(scale_px), F.lit(0.0))
