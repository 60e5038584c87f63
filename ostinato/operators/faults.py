"""Implausible readings: out of range, spikes beyond an extreme-value cutoff, values that stand still.

Readings are cut into blocks of frames with a halo on either side, the blocks are hashed into buckets,
and each bucket is scored with numpy. A reading's residual is the distance by which it (alone or with up
to MOST_SPIKE - 1 neighbours) lies outside the range of the readings right before and after, in units of
the scatter there; a reading near a hole in time counts half. This level of the moment is what is taken off
for the season: a slower or periodic component is the same on either side of a reading. The residuals of each
series are reduced to a histogram of fixed size. A generalised Pareto distribution, fitted to the part of the
tail below CENSOR so that faults don't widen it, gives the cutoff of a series that is passed at a risk of RISK;
no residual below CENSOR is a spike. To a series' own counts come those of its label as if they were
PRIOR_READINGS more readings, so that short series go by their label and long ones by themselves.

A stretch is still where steps stay under STILL times the usual step: the median one of the block, or half of what
it is in most blocks of the series (a twentieth of what it is in the label), whichever is more, so that a fault that
fills a block doesn't become what is usual. Natural stretches lengthen geometrically; the length that one is
passed with at a risk of STILL_RISK is the cutoff of a series, PRIOR_STRETCHES of its label added to its own.

Nulls: readings without series_id, frame_idx or v are never flagged; a missing t lies between those beside it; a
label that is null or has no limits has no plausible range but is scored like any other. Copies (same series_id and
frame_idx) count once. Infinite values lie outside any range. Negative frames belong to the first block. Extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ostinato.session import broadcast_if_small, checkpointed, parts_for, present

BLOCK = 8192
HALO = 256  # no cutoff for still stretches is longer
ROWS_A_BUCKET = 60_000
FLANK = 4
MOST_SPIKE = 3
HOLE = 3.5  # usual steps without a reading that make a hole
REACH = FLANK + MOST_SPIKE + 1
RISK = 1e-5
CENSOR = 5.0  # beyond it, residuals may be faults and are only counted as "more than this"
PRIOR_READINGS, PRIOR_STRETCHES = 2000.0, 50.0
ROUGH_CUT = 8.0  # a reading beyond it is taken out before its neighbours are scored again
STILL = 0.02
STILL_RISK = 1e-9
LEAST_STILL = 8
BIN = 0.125
SHARE_OF_SERIES, SHARE_OF_LABEL = 0.5, 0.05
CORE, BAD, TWO_STATE = 1, 2, 4
ROWS_A_TASK = 1_000_000
#: kind: range, spike, still (a row each), residual and stretch (counts by score), step (score: usual step, n: steps).
FACTS = "kind string, series_id long, block long, frame_idx long, source long, score double, n long"


def _windows(x: np.ndarray, pad, width: int) -> np.ndarray:
    side = np.full(FLANK, pad, dtype=x.dtype)
    return np.lib.stride_tricks.sliding_window_view(np.concatenate([side, x, side]), width)


def residuals(v: np.ndarray, t: np.ndarray, seg: np.ndarray, floor: np.ndarray, still: np.ndarray, pace: np.ndarray) -> np.ndarray:
    """Residual of each value of consecutive segments, in units of local scatter (floor: the least of it).

    Steps between values of a still stretch say nothing about scatter. pace: usual time from reading to reading.
    """
    best = np.zeros(len(v))
    with np.errstate(all="ignore"):
        for m in range(1, MOST_SPIKE + 1):
            if len(v) < m + 2:
                break
            width = 2 * FLANK + m
            own = _windows(seg, -1, width)
            same = own == own[:, FLANK : FLANK + 1]
            w = np.where(same, _windows(v, np.nan, width), np.nan)
            times = _windows(t, np.nan, width)
            group, before, after = w[:, FLANK : FLANK + m], w[:, :FLANK], w[:, FLANK + m :]
            near = np.concatenate([before[:, -3:], after[:, :3]], axis=1)
            lo, hi = np.fmin.reduce(near, axis=1), np.fmax.reduce(near, axis=1)
            out = np.maximum(group - hi[:, None], lo[:, None] - group).min(axis=1)
            stands = _windows(still, False, width)
            db = np.where(stands[:, : FLANK - 1] & stands[:, 1:FLANK], np.nan, np.abs(np.diff(before, axis=1)))
            da = np.where(stands[:, FLANK + m : -1] & stands[:, FLANK + m + 1 :], np.nan, np.abs(np.diff(after, axis=1)))
            steps = np.sort(np.concatenate([db, da], axis=1), axis=1)  # NaN last
            known = np.isfinite(steps).sum(axis=1)
            middle = np.take_along_axis(steps, np.maximum((known - 1) // 2, 0)[:, None], axis=1)[:, 0]
            upper = np.take_along_axis(steps, np.minimum(known // 2, np.maximum(known - 1, 0))[:, None], axis=1)[:, 0]
            largest = np.fmax(np.fmax.reduce(db[:, -2:], axis=1), np.fmax.reduce(da[:, :2], axis=1))
            scatter = np.fmax(np.fmax((middle + upper) / 2, 0.5 * largest), floor[: len(out)])
            around = np.diff(times[:, FLANK - 1 : FLANK + m + 1], axis=1)
            z = out / scatter * np.where(np.fmax.reduce(np.abs(around), axis=1) > HOLE * pace[: len(out)], 0.5, 1.0)
            z = np.where(same[:, FLANK - 1] & same[:, FLANK + m] & same[:, FLANK : FLANK + m].all(axis=1) & np.isfinite(z), z, 0.0)
            for j in range(m):
                np.maximum(best[j : j + len(z)], z, out=best[j : j + len(z)])
    return best


def stretches(v: np.ndarray, seg: np.ndarray, least_step: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start of the still stretch each value belongs to, and its length."""
    n = len(v)
    go = np.zeros(n, dtype=bool)
    go[1:] = (seg[1:] == seg[:-1]) & (np.abs(np.diff(v)) <= least_step[1:])
    start = np.maximum.accumulate(np.where(go, 0, np.arange(n)))
    return start, np.bincount(start, minlength=n)[start]


def _widened(mask: np.ndarray, reach: int) -> np.ndarray:
    """mask, and `reach` places on either side of what it holds."""
    ends = np.cumsum(np.concatenate([[0] * (reach + 1), mask.astype(np.int64), [0] * reach]))
    return (ends[2 * reach + 1 :] - ends[: -2 * reach - 1]) > 0


def _usual_step(v: np.ndarray, seg: np.ndarray) -> np.ndarray:
    """Median of the steps other than zero of the segment, for each value."""
    d = pd.Series(np.abs(np.diff(v, prepend=np.nan)))
    d[np.concatenate([[True], seg[1:] != seg[:-1]])] = np.nan
    return d.where(d > 0).groupby(seg).transform("median").fillna(0.0).to_numpy()


def _times(t: np.ndarray, seg: np.ndarray) -> np.ndarray:
    """t with missing times between those beside them; a segment without any has equal steps."""
    lost = ~np.isfinite(t)
    if lost.any():
        for i in np.unique(seg[lost]).tolist():
            lo, hi = np.searchsorted(seg, [i, i + 1])
            own, at = t[lo:hi], np.arange(hi - lo)
            known = np.isfinite(own)
            t[lo:hi] = np.interp(at, at[known], own[known]) if known.any() else at
    return t


def score_bucket(data: pa.Table) -> pa.Table:
    """Facts of one bucket: rows that may be faults, and what the fits need, reduced to counts."""
    if data.num_rows == 0:
        return _facts([])
    g = data.to_pandas().sort_values(["series_id", "block", "frame_idx"], kind="stable", ignore_index=True)
    g = g[~g.duplicated(["series_id", "block", "frame_idx"])].reset_index(drop=True)
    flags = g["flags"].to_numpy()
    bad, core = (flags & BAD) > 0, (flags & CORE) > 0
    facts = [_rows("range", g[bad & core], 0.0)]
    g = g[~bad & ((flags & TWO_STATE) == 0)].reset_index(drop=True)
    if len(g):
        v, t, core = g["v"].to_numpy(), g["t"].to_numpy().copy(), (g["flags"].to_numpy() & CORE) > 0
        new = np.ones(len(g), dtype=bool)
        new[1:] = (np.diff(g["series_id"].to_numpy()) != 0) | (np.diff(g["block"].to_numpy()) != 0)
        seg = np.cumsum(new)
        t = _times(t, seg)
        own, pace = _usual_step(v, seg), _usual_step(t, seg)
        usual = np.maximum(own, g["least"].to_numpy()) if "least" in g.columns else own
        z, keep = np.zeros(len(g)), np.ones(len(g), dtype=bool)
        near = np.ones(len(g), dtype=bool)
        for _ in range(3):
            i = np.flatnonzero(keep)
            still = stretches(v[i], seg[i], STILL * usual[i])[1] >= LEAST_STILL
            # After the first time only the surroundings of what was taken out are scored again, with as much around them as a score looks at.
            at = np.flatnonzero(_widened(near[i], REACH))
            part = np.cumsum(np.diff(at, prepend=-2) > 1) + seg[i][at] * len(g)
            now = residuals(v[i][at], t[i][at], part, 0.7 * usual[i][at] + 1e-12, still[at], pace[i][at])
            now[~near[i][at]] = 0.0
            at = i[at]
            z[at] = np.maximum(z[at], now)
            if not (far := at[now > ROUGH_CUT]).size:
                break
            near = np.zeros(len(g), dtype=bool)
            near[far] = True
            keep[far] = False
            near[i] = _widened(near[i], REACH)
        facts.append(_rows("spike", g[core & (z >= CENSOR)], z[core & (z >= CENSOR)]))
        facts.append(_counts("residual", g[core], (np.minimum(z, CENSOR) / BIN).astype(np.int64)[core]))
        i = np.flatnonzero(keep)
        start, length = stretches(v[i], seg[i], STILL * usual[i])
        long = core[i] & (length >= LEAST_STILL)
        facts.append(_rows("still", g.iloc[i[long]], length[long]))
        first = core[i] & (start == np.arange(len(i))) & (length > 1)
        facts.append(_counts("stretch", g.iloc[i[first]], np.minimum(length[first], HALO)))
        head = np.flatnonzero(new)
        steps = np.bincount(seg - 1) - 1
        facts.append(_rows("step", g.iloc[head], own[head]).assign(n=steps)[(own[head] > 0) & (steps > 0)])
    return _facts(facts)


def _rows(kind: str, g: pd.DataFrame, score) -> pd.DataFrame:
    return pd.DataFrame({"kind": kind, "series_id": g["series_id"], "block": g["block"], "frame_idx": g["frame_idx"], "source": g["source"], "score": score, "n": 1})


def _counts(kind: str, g: pd.DataFrame, what: np.ndarray) -> pd.DataFrame:
    c = g[["series_id", "block", "source"]].assign(score=what).value_counts(dropna=False).reset_index(name="n")
    return c.assign(kind=kind, frame_idx=None)


def _facts(parts: list[pd.DataFrame]) -> pa.Table:
    schema = pa.schema([("kind", pa.string()), ("series_id", pa.int64()), ("block", pa.int64()), ("frame_idx", pa.int64()), ("source", pa.int64()), ("score", pa.float64()), ("n", pa.int64())])
    return pa.concat_tables([schema.empty_table(), *(pa.Table.from_pandas(p[schema.names], schema=schema, preserve_index=False) for p in parts if len(p))])


@cache
def _tails(width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Candidates of a tail of `width` bins: shape, scale, logarithm of the share of each bin, share of the tail within the bins."""
    shape, scale = (x.ravel() for x in np.meshgrid(np.arange(-0.2, 0.51, 0.05).round(2), np.geomspace(0.05, 3.0, 60), indexing="ij"))
    edges = np.arange(width + 1) * BIN
    with np.errstate(all="ignore"):
        line = np.exp(-edges / scale[:, None])
        power = np.maximum(1 + shape[:, None] * edges / scale[:, None], 0) ** (-1 / np.where(shape == 0, 1, shape)[:, None])
        past = np.where(shape[:, None] == 0, line, power)
        inside = 1 - past[:, -1]
        share = np.log((past[:, :-1] - past[:, 1:]) / inside[:, None])
    return shape, scale, np.where(np.isfinite(share), share, -1e12), inside


def tail_cutoff(counts: np.ndarray, beyond: float, risk: float = RISK) -> float:
    """Cutoff passed at `risk` by a generalised Pareto tail fitted to counts per bin from 0, of which `beyond` lie past the last.

    The tail starts at the 98th percentile. Bins past the start are fitted by likelihood, censored at the last
    edge: those beyond, faults among them, carry no weight. Without any reading the cutoff is infinite.
    """
    total = counts.sum() + beyond
    if total <= 0:
        return float("inf")
    at = min(int(np.searchsorted(np.cumsum(counts), 0.98 * total)), len(counts) - 2)
    tail = counts[at:].astype(float)
    if tail.sum() <= 0:
        return len(counts) * BIN
    shape, scale, share, inside = _tails(len(tail))
    best = int((share @ tail).argmax())
    rate = tail.sum() / max(inside[best], 1e-9) / total
    c, s = shape[best], scale[best]
    x = s * np.log(rate / risk) if c == 0 else s / c * ((rate / risk) ** c - 1)
    return float(max(at * BIN + x, len(counts) * BIN))


def still_cutoff(goes_on: float, ends: float, risk: float = STILL_RISK) -> float:
    """Length that a natural stretch passes at `risk`, going by how often short stretches go on and end."""
    p = (goes_on + 0.5) / (goes_on + ends + 1.0)
    return float(np.clip(2 + np.log(risk) / np.log(p), LEAST_STILL, HALO))


def _tally(facts: Sequence) -> tuple[np.ndarray, np.ndarray]:
    """Residuals by bin, those beyond last, and how often short stretches go on and end."""
    size = int(CENSOR / BIN)
    bins, stretch = np.zeros(size + 1), np.zeros(2)
    for f in facts:
        if f["kind"] == "residual":
            bins[int(f["score"])] += f["n"]
        elif f["score"] < LEAST_STILL:
            stretch += ((f["score"] - 2) * f["n"], f["n"])
    return bins, stretch


def _fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Cutoffs of each series from its own counts and those of its label."""
    priors: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for g in batches:
        spike, still = [], []
        for source, own, label in zip(g["source"], g["own"], g["of_label"], strict=True):
            if source not in priors:
                bins, stretch = _tally(label)
                priors[source] = bins / max(bins.sum(), 1.0) * PRIOR_READINGS, stretch / max(stretch.sum(), 1.0) * PRIOR_STRETCHES
            bins, stretch = (mine + more for mine, more in zip(_tally(own), priors[source], strict=True))
            spike.append(tail_cutoff(bins[:-1], bins[-1]))
            still.append(still_cutoff(*stretch))
        yield pd.DataFrame({"series_id": g["series_id"], "spike_cut": spike, "still_cut": still})


def _blocked(readings: DataFrame, limits: DataFrame, two_state: Sequence[str]) -> DataFrame:
    """Readings that are there, in blocks with a halo; what their label says about them is two numbers."""
    lim = limits.select("label", F.col("lo").cast("double").alias("lo"), F.col("hi").cast("double").alias("hi")).filter("label IS NOT NULL").dropDuplicates(["label"])
    frame = F.col("frame_idx").cast("long")
    own = F.greatest(F.floor(frame / BLOCK), F.lit(0).cast("long"))
    rest = frame - own * BLOCK
    near = F.when((rest < HALO) & (own > 0), own - 1).when(rest >= BLOCK - HALO, own + 1)
    v = F.col("v").cast("double")
    bad = (v < F.coalesce("lo", F.lit(float("-inf")))) | (v > F.coalesce("hi", F.lit(float("inf")))) | (F.abs(v) == float("inf"))
    two = F.coalesce(F.col("label").isin(*two_state), F.lit(False))
    x = readings.select("series_id", "frame_idx", "label", "t", "v").filter(present("v") & F.col("series_id").isNotNull() & frame.isNotNull()).join(broadcast_if_small(lim), "label", "left")
    return x.select(
        F.col("series_id").cast("long").alias("series_id"), frame.alias("frame_idx"), F.col("t").cast("double").alias("t"), v.alias("v"), F.xxhash64("label").alias("source"),
        (bad.cast("int") * BAD + two.cast("int") * TWO_STATE).alias("flags"), own.alias("own"), F.explode(F.array_compact(F.array(own, near))).alias("block"),
    ).withColumn("flags", F.col("flags") + (F.col("block") == F.col("own")).cast("int") * CORE).drop("own")


def _scored(rows: DataFrame, n: int) -> DataFrame:
    buckets = parts_for(n, ROWS_A_BUCKET)
    tasks = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), n // ROWS_A_TASK)
    return rows.withColumn("bucket", F.pmod(F.hash("series_id", "block"), F.lit(buckets))).repartition(tasks, "bucket").groupBy("bucket").applyInArrow(score_bucket, FACTS)


def fault_facts(readings: DataFrame, limits: DataFrame, two_state: Sequence[str] = ("tongue_contact",)) -> DataFrame:
    """Scored candidates and counts (FACTS) of all readings; see score_bucket. Blocks whose own usual step is far below the series' are scored again."""
    rows = _blocked(readings, limits, two_state)
    facts = checkpointed(_scored(rows, readings.count()))
    steps = facts.filter("kind = 'step'")
    of_series = steps.groupBy("series_id", "source").agg(F.percentile("score", 0.75, F.col("n")).alias("of_series"))
    of_label = of_series.groupBy("source").agg(F.percentile_approx("of_series", 0.5).alias("of_label"))
    least = F.greatest(F.col("of_series") * SHARE_OF_SERIES, F.col("of_label") * SHARE_OF_LABEL)
    low = steps.join(of_series, ["series_id", "source"]).join(broadcast_if_small(of_label), "source").select("series_id", "block", "score", least.alias("least")).filter("score < least")
    low = checkpointed(low.select("series_id", "block", "least"))
    n = low.count()
    if not n:
        return facts
    low = broadcast_if_small(low)
    again = _scored(rows.join(low, ["series_id", "block"]), n * BLOCK)
    return facts.join(low, ["series_id", "block"], "left_anti").select(*facts.columns).unionByName(again)


def flag_faults(readings: DataFrame, limits: DataFrame, two_state: Sequence[str] = ("tongue_contact",)) -> DataFrame:
    """Faulty readings, one row for each and reason: series_id, frame_idx, label, reason (range|spike|still), score, cutoff.

    No readings: no rows. What is read twice, candidates and counts, is a small part of the readings and
    is written to the checkpoint folder.
    """
    facts = checkpointed(fault_facts(readings, limits, two_state))
    entry = F.struct("kind", "score", "n")
    counts = facts.filter("kind IN ('residual', 'stretch')").groupBy("series_id", "source", "kind", "score").agg(F.sum("n").alias("n"))
    own = counts.groupBy("series_id", "source").agg(F.collect_list(entry).alias("own"))
    label = counts.groupBy("source", "kind", "score").agg(F.sum("n").alias("n")).groupBy("source").agg(F.collect_list(entry).alias("of_label"))
    cuts = own.join(broadcast_if_small(label), "source").mapInPandas(_fit, "series_id long, spike_cut double, still_cut double")
    names = readings.select("label").distinct().withColumn("source", F.xxhash64("label"))
    found = facts.filter("kind IN ('range', 'spike', 'still')").join(cuts, "series_id", "left")
    cutoff = F.when(F.col("kind") == "spike", F.col("spike_cut")).when(F.col("kind") == "still", F.col("still_cut"))
    found = found.select("series_id", "frame_idx", "source", F.col("kind").alias("reason"), "score", cutoff.alias("cutoff")).filter("reason = 'range' OR score >= cutoff")
    return found.join(broadcast_if_small(names), "source").select("series_id", "frame_idx", "label", "reason", "score", "cutoff")
