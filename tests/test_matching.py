"""Greedy matches and robust lines of hot groups: as listing every pair, without a list of every pair."""

import tracemalloc

import numpy as np
import pytest

from ostinato.operators import sequences, video


def listed(x, y, most):
    d = np.abs(np.subtract.outer(x, y))
    i, j = np.nonzero(d < most)
    used_x, used_y, out = set(), set(), []
    for k in np.lexsort((j, i, d[i, j])):
        a, b = int(i[k]), int(j[k])
        if a not in used_x and b not in used_y:
            used_x.add(a)
            used_y.add(b)
            out.append((a, b))
    return out


@pytest.mark.parametrize("seed", range(40))
def test_greedy_pairs_as_listed(seed):
    rng = np.random.default_rng(seed)
    x, y = (np.sort(rng.integers(0, 60, size=rng.integers(0, 50)) / 4 if seed % 2 else rng.uniform(0, 20, size=50)) for _ in range(2))
    assert sequences.greedy_pairs(x, y, 0.75) == listed(x, y, 0.75)


def peak_mb(f):
    tracemalloc.start()
    f()
    peak = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    return peak


def test_memory_grows_with_rows_not_pairs():
    rng = np.random.default_rng(0)
    x, y = np.sort(rng.uniform(0, 900, 3000)), np.sort(rng.uniform(0, 900, 3000))
    assert peak_mb(lambda: sequences.greedy_pairs(x, y, 0.5)) < 20  # all distances: 72 MB
    assert peak_mb(lambda: video.robust_line(x, y)) < 5  # all pairs: over 100 MB


def test_greedy_match_of_stretches(spark):
    rng = np.random.default_rng(5)
    left = {k: np.sort(rng.integers(0, 800, size=120) / 4) for k in ("a", None)}
    right = {k: np.sort(rng.integers(0, 800, size=150) / 4) for k in ("a", None, "b")}
    frame = lambda by: spark.createDataFrame([(k, float(t)) for k, v in by.items() for t in v] + [("a", None), ("a", float("nan"))], "file string, t double")
    got = sequences.greedy_match(frame(left), frame(right), ["file"], 0.5)
    assert got.columns == ["file", "left_t", "right_t"]
    want = [(k, left[k][i], right[k][j]) for k in left for i, j in listed(left[k], right[k], 0.5)]
    assert sorted(map(repr, ((r[0], r[1], r[2]) for r in got.collect()))) == sorted(repr((k, float(a), float(b))) for k, a, b in want)


@pytest.mark.parametrize("seed", range(12))
def test_counted_slope_as_listed(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(2, 300))
    t = rng.integers(0, 90, size=n).astype(float) if seed % 2 else np.sort(rng.uniform(0, 1e5, size=n))
    y = rng.integers(20, 30, size=n).astype(float) if seed % 3 else 0.003 * t + rng.normal(size=n)
    i, j = np.triu_indices(n, 1)
    run = t[j] - t[i]
    want = np.median((y[j] - y[i])[run != 0] / run[run != 0]) if (run != 0).any() else 0.0
    assert abs(video._median_slope(t, y) - want) <= 1e-12 * max(1e-3, abs(want))
