"""Alignment of played notes with a score."""

from __future__ import annotations

import math
from collections.abc import Iterator
from difflib import SequenceMatcher
from heapq import heappop, heappush

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ostinato.operators import blocks, intervals
from ostinato.operators.grouped import per_group
from ostinato.session import checkpointed, present

GAP = -1
#: Cells of a table up to which lists are quicker than arrays.
_FEW = 8192


def align(x, y, match: float = 1, mismatch: float = 1, gap: float = 2, border_gap: float = 1) -> list[tuple[int, int]]:
    """Global alignment at the highest score: pairs of places in x and y, GAP for none.

    Of equal choices a pair is preferred to a gap in y, that to a gap in x. Gaps before the first or after none
    of the other sequence cost border_gap each.
    """
    x, y = list(x), list(y)
    n, m = len(x), len(y)
    best = [[-border_gap * j for j in range(m + 1)]]
    for i in range(1, n + 1):
        above, left = best[-1], -border_gap * i
        row = [left]
        for j in range(1, m + 1):
            left = max(above[j - 1] + (match if x[i - 1] == y[j - 1] else -mismatch), above[j] - gap, left - gap)
            row.append(left)
        best.append(row)
    out, i, j = [], n, m
    while i or j:
        if i and j and best[i][j] == best[i - 1][j - 1] + (match if x[i - 1] == y[j - 1] else -mismatch):
            i, j = i - 1, j - 1
            out.append((i, j))
        elif i and (not j or best[i][j] == best[i - 1][j] - gap):
            i -= 1
            out.append((i, GAP))
        else:
            j -= 1
            out.append((GAP, j))
    return out[::-1]


def _placed(pairs, size: int) -> list[tuple[int, int, int]]:
    """Pairs of places in a repeated score as (place in score, place in played, repetition from 1); -1 for none."""
    return [(i % size if i >= 0 else GAP, j, i // size + 1 if i >= 0 else GAP) for i, j in pairs]


def repeated(score, played, times: int) -> tuple[list[tuple[int, int, int, int]], int]:
    """Alignment of the score played `times` times: (place in score, place in played, repetition from 1, both -1 for none), and its cost.

    The cost counts pairs that differ once and gaps twice.
    """
    rows = _placed(align(list(score) * times, list(played), gap=2), len(score))
    cost = sum(2 if GAP in (i, j) else int(score[i] != played[j]) for i, j, _ in rows)
    return rows, cost


def _rows(above: np.ndarray, differs: list[np.ndarray], first: int, last: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Rows of align's table for the repeated score after row `above`: number, scores, where a pair is chosen, where a gap in played.

    differs: for each place of the score (once), where played differs from it. Elsewhere a gap in the score is chosen.
    """
    gaps = 2 * np.arange(len(above), dtype=np.int32)
    for i in range(first, last + 1):
        pair = above[:-1] + 1 - 2 * differs[(i - 1) % len(differs)]
        gap = above[1:] - 2
        row = np.empty_like(above)
        row[0] = -i
        np.maximum(pair, gap, out=row[1:])
        row += gaps  # a gap in the score costs 2 a place: what remains is a running maximum
        np.maximum.accumulate(row, out=row)
        row -= gaps
        paired = row[1:] == pair
        yield i, row, paired, ~paired & (row[1:] == gap)
        above = row


def best_repetitions(score, played) -> tuple[int, list[tuple[int, int, int]]]:
    """Number of repetitions with the least cost (the first of equal ones) around the ratio of lengths, and its alignment, as repeated gives them.

    All numbers of repetitions share one table: fewer repetitions are its first rows. The cost of each cell's alignment goes along
    with its score. Some rows are held, and the choices between them are found again on the way back, so memory grows with the
    number of played notes times the root of the table's rows.
    """
    score, played = list(score), list(played)
    size, n = len(score), len(played)
    guess = round(n / size)
    tried = range(max(1, guess // 2), max(int(guess * 1.5), 3))
    if n * size * tried[-1] <= _FEW:
        (rows, _), k = min(((repeated(score, played, k), k) for k in tried), key=lambda f: f[0][1])
        return k, rows
    of = {p: (np.array(played) != p).astype(np.int32) for p in set(score)}
    differs = [of[p] for p in score]
    places = np.arange(n + 1, dtype=np.int32)
    gaps, cost, costs = 2 * places, 2 * places, {}
    last = size * tried[-1]
    block = math.isqrt(last) + 1
    held = {0: -places}
    for i, row, paired, gap in _rows(held[0], differs, 1, last):
        own = np.empty_like(cost)
        own[0] = 2 * i
        own[1:] = np.where(paired, cost[:-1] + differs[(i - 1) % size], cost[1:] + 2) - gaps[1:]
        come = places.copy()  # the place before the gaps in the score that end here
        come[1:] *= paired | gap
        cost = own[np.maximum.accumulate(come)] + gaps
        if i % size == 0:
            costs[i // size] = int(cost[-1])
        if i % block == 0:
            held[i] = row
    k = min(tried, key=costs.__getitem__)
    out, i, j = [], size * k, n
    while i:
        start = (i - 1) // block * block
        choices = [(paired, gap) for _, _, paired, gap in _rows(held[start], differs, start + 1, i)]
        while i > start:
            paired, gap = choices[i - start - 1]
            if j and paired[j - 1]:
                i, j = i - 1, j - 1
                out.append((i, j))
            elif not j or gap[j - 1]:
                i -= 1
                out.append((i, GAP))
            else:
                j -= 1
                out.append((GAP, j))
    out.extend((GAP, p) for p in range(j - 1, -1, -1))
    return k, _placed(out[::-1], size)


def align_takes(played: DataFrame, score: DataFrame, keys: list[str]) -> DataFrame:
    """Played notes (keys, tune, place, pitch) against the score of their tune (tune, place, pitch).

    One row for each pair or gap: keys, score_place, played_place, repetition; gaps are null. Takes of tunes without a score give no rows.
    """
    scores = score.filter("pitch IS NOT NULL").groupBy("tune").agg(F.sort_array(F.collect_list(F.struct("place", "pitch"))).alias("score"))
    takes = played.filter("pitch IS NOT NULL").groupBy(*keys, "tune").agg(F.sort_array(F.collect_list(F.struct("place", "pitch"))).alias("played"))

    def run(g: pd.DataFrame) -> pd.DataFrame:
        written = [(r["place"], r["pitch"]) for r in g["score"].iloc[0]]
        heard = [(r["place"], r["pitch"]) for r in g["played"].iloc[0]]
        _, rows = best_repetitions([p for _, p in written], [p for _, p in heard])
        return pd.DataFrame(
            {
                "score_place": pd.array([written[i][0] if i >= 0 else None for i, _, _ in rows], dtype="Int64"),
                "played_place": pd.array([heard[j][0] if j >= 0 else None for _, j, _ in rows], dtype="Int64"),
                "repetition": pd.array([k if k > 0 else None for _, _, k in rows], dtype="Int64"),
            }
        )

    return per_group(takes.join(scores, "tune"), keys, run, "score_place long, played_place long, repetition long")


def best_shift(score, played, shifts) -> tuple[float, float]:
    """Shift in semitones at which the rounded played pitches resemble the score most, and the ratio; of equal ones the smallest."""
    found = [(SequenceMatcher(None, [round(p + s) for p in played], list(score), autojunk=False).ratio(), s) for s in shifts]
    ratio = max(f[0] for f in found)
    return min((s for r, s in found if r == ratio), key=abs), ratio


def tuning_shifts(played: DataFrame, score: DataFrame, keys: list[str], most: float = 2.0, step: float = 0.1) -> DataFrame:
    """keys, shift, ratio: how far each take is out of tune with its score; played pitches are fractional semitones."""
    scores = score.filter("pitch IS NOT NULL").groupBy("tune").agg(F.sort_array(F.collect_list(F.struct("place", "pitch"))).alias("score"))
    takes = played.filter("pitch IS NOT NULL").groupBy(*keys, "tune").agg(F.sort_array(F.collect_list(F.struct("place", "pitch"))).alias("played"))
    n = round(most / step)
    shifts = [round(i * step, 6) for i in range(-n, n + 1)]

    def run(g: pd.DataFrame) -> pd.DataFrame:
        shift, ratio = best_shift([r["pitch"] for r in g["score"].iloc[0]], [r["pitch"] for r in g["played"].iloc[0]], shifts)
        return pd.DataFrame({"shift": [shift], "ratio": [ratio]})

    return per_group(takes.join(scores, "tune"), keys, run, "shift double, ratio double")


def greedy_pairs(x: np.ndarray, y: np.ndarray, most: float) -> list[tuple[int, int]]:
    """Pairs of places in ascending x and y, nearest first, each place once, closer than `most`; of equal distances the first places.

    The nearest pair of those left is always beside each other on the line of all times: only such pairs are held.
    """
    nodes: list[tuple[float, int, list[int]]] = []  # time, side, places from the last to the first
    for side, times in enumerate((x, y)):
        held: dict[float, list[int]] = {}
        for i, t in enumerate(times.tolist()):
            if t == t:
                held.setdefault(t, []).append(i)
        nodes.extend((t, side, places[::-1]) for t, places in held.items())
    nodes.sort(key=lambda n: n[:2])
    before, after = list(range(-1, len(nodes) - 1)), [*range(1, len(nodes)), -1]
    heap: list[tuple[float, int, int, int, int]] = []

    def offer(a: int, b: int) -> None:
        if a >= 0 and b >= 0 and nodes[a][1] != nodes[b][1]:
            left, right = (a, b) if nodes[a][1] == 0 else (b, a)
            if (d := abs(nodes[left][0] - nodes[right][0])) < most:
                heappush(heap, (d, nodes[left][2][-1], nodes[right][2][-1], a, b))

    for a in range(len(nodes) - 1):
        offer(a, a + 1)
    out = []
    while heap:
        _, i, j, a, b = heappop(heap)
        left, right = (a, b) if nodes[a][1] == 0 else (b, a)
        if after[a] != b or nodes[left][2][-1:] != [i] or nodes[right][2][-1:] != [j]:
            continue
        out.append((i, j))
        nodes[left][2].pop()
        nodes[right][2].pop()
        outer_a, outer_b = before[a], after[b]
        line = [n for n in (outer_a, a, b, outer_b) if n < 0 or n in (outer_a, outer_b) or nodes[n][2]]
        for n in (a, b):
            if not nodes[n][2]:
                before[n] = after[n] = -2
        for p, q in zip(line, line[1:], strict=False):
            if p >= 0:
                after[p] = q
            if q >= 0:
                before[q] = p
            offer(p, q)
    return out


def greedy_match(left: DataFrame, right: DataFrame, keys: list[str], most: float) -> DataFrame:
    """One-to-one matches of times (keys, t) of two tables within a key: keys, left_t, right_t.

    Times of left that are 2 * most or farther apart share no match: a key is cut there, and each stretch is matched by itself.
    """
    spare = 1e-3  # more than sums of times are off
    one = F.to_json(F.struct(*keys)).alias("__key")  # null keys too
    kept = left.select(*keys).schema
    x = left.filter(present("t")).select(one, F.col("t").cast("double").alias("t"), F.monotonically_increasing_id().alias("__id"))
    x = checkpointed(x)  # the ids stay as they are
    x = blocks.neighbour(blocks.parted(x, "t", blocks.SECONDS), ["__key"], ["t", "__id"], F.struct("t"), "__last")
    new = F.when(F.col("__last").isNull() | (F.col("t") - F.col("__last.t") >= 2 * most + 4 * spare), 1).otherwise(0).cast("long")
    x = checkpointed(blocks.running_total(x, ["__key"], ["t", "__id"], new, "__stretch"))
    stretches = x.groupBy("__key", "__stretch").agg((F.min("t") - most - spare).alias("start"), (F.max("t") + most + spare).alias("end"))
    y = intervals.interval_join(right.filter(present("t")).select(one, F.col("t").cast("double").alias("t")), stretches, ["__key"])
    columns = ["__key", "__stretch", "t"]
    both = x.select(*columns, F.lit(0).alias("side")).unionByName(y.select(*columns, F.lit(1).alias("side")))

    def run(g: pd.DataFrame) -> pd.DataFrame:
        x, y = (np.sort(g["t"][g["side"] == s].to_numpy()) for s in (0, 1))
        pairs = greedy_pairs(x, y, most)
        return pd.DataFrame({"left_t": [x[i] for i, _ in pairs], "right_t": [y[j] for _, j in pairs]}, dtype="float64")

    return per_group(both, ["__key", "__stretch"], run, "left_t double, right_t double").select(F.from_json("__key", kept).alias("k"), "left_t", "right_t").select("k.*", "left_t", "right_t")


def greedy_corners(df: DataFrame, keys: list[str], side: str, key: str, x: str, y: str, cost=None) -> DataFrame:
    """Points of two sides (0 and 1) of a group matched one to one, the nearest pair first, until one side is used up: keys, left, right, distance.

    cost: distance of (x, y) of one point to those of several, Euclid's if there's none. Of equal pairs the first keys are taken.
    A group is a frame: few points.
    """
    far = cost or (lambda p, q: np.hypot(q[:, 0] - p[0], q[:, 1] - p[1]))

    def run(g: pd.DataFrame) -> pd.DataFrame:
        a, b = (g[g[side] == s].sort_values(key) for s in (0, 1))
        p, q = a[[x, y]].to_numpy(dtype=float), b[[x, y]].to_numpy(dtype=float)
        d = np.array([far(one, q) for one in p]).reshape(len(p), len(q))
        out = []
        while d.size and np.isfinite(d).any():
            i, j = divmod(int(np.nanargmin(d)), d.shape[1])
            out.append((a[key].iloc[i], b[key].iloc[j], float(d[i, j])))
            d[i], d[:, j] = np.inf, np.inf
        return pd.DataFrame(out, columns=["left", "right", "distance"])

    return per_group(df.select(*keys, side, key, x, y).filter(present(x) & present(y)), keys, run, "left long, right long, distance double")
