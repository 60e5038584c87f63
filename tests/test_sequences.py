import time

import numpy as np
import pandas as pd
from hypothesis import given, settings
from hypothesis import strategies as st

from ostinato.operators import segment, sequences, signals, video


def score_of(pairs, x, y, gap=2.0, border=1.0):
    """Score of an alignment; gaps at the start cost border each."""
    total, begun = 0.0, {0: False, 1: False}
    i = j = 0
    for a, b in pairs:
        if a >= 0 and b >= 0:
            total += 1 if x[a] == y[b] else -1
        elif a >= 0:
            total -= border if j == 0 else gap
        else:
            total -= border if i == 0 else gap
        i += a >= 0
        j += b >= 0
    return total


def best_score(x, y, gap=2.0, border=1.0):
    from functools import cache

    @cache
    def f(i, j):
        if i == 0 or j == 0:
            return -border * (i + j)
        return max(f(i - 1, j - 1) + (1 if x[i - 1] == y[j - 1] else -1), f(i - 1, j) - gap, f(i, j - 1) - gap)

    return f(len(x), len(y))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=8), st.lists(st.integers(0, 3), max_size=8))
def test_alignment_is_optimal_and_whole(x, y):
    pairs = sequences.align(x, y)
    assert [a for a, _ in pairs if a >= 0] == list(range(len(x)))
    assert [b for _, b in pairs if b >= 0] == list(range(len(y)))
    assert score_of(pairs, x, y) == best_score(tuple(x), tuple(y))


def test_same_sequence_has_no_gaps():
    assert sequences.align([1, 2, 3], [1, 2, 3]) == [(0, 0), (1, 1), (2, 2)]


def test_repetitions():
    score = [1, 5, 3, 7]
    assert sequences.best_repetitions(score, score * 3)[0] == 3
    assert sequences.best_repetitions(score, [1, 5, 7])[0] == 1
    assert sequences.repeated(score, [1, 5, 7], 1)[1] == 2  # a gap counts twice


def _by_each(score, played):
    """best_repetitions by an alignment of its own for each number."""
    guess = round(len(played) / len(score))
    (rows, _), k = min(((sequences.repeated(score, played, k), k) for k in range(max(1, guess // 2), max(int(guess * 1.5), 3))), key=lambda f: f[0][1])
    return k, rows


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=8), st.lists(st.integers(0, 3), max_size=40))
def test_repetitions_share_a_table(score, played):
    few, sequences._FEW = sequences._FEW, -1
    try:
        assert sequences.best_repetitions(score, played) == _by_each(score, played)
    finally:
        sequences._FEW = few


def test_repetitions_of_a_long_take():
    """A recording with thousands of notes: its work grows with the square of the notes, not the cube (minutes)."""
    rng = np.random.default_rng(3)
    score = rng.integers(57, 80, 24).tolist()
    played = score * 80
    for i in rng.integers(0, len(played), 100):
        played[i] += 1
    began = time.process_time()
    k, rows = sequences.best_repetitions(score, played)
    assert time.process_time() - began < 15
    assert k == 80 and [j for _, j, _ in rows if j >= 0] == list(range(len(played)))
    wrong = sum(played[j] != score[i] for i, j, _ in rows if i >= 0 and j >= 0)
    assert len(rows) == len(played) and wrong == sum(p != q for p, q in zip(played, score * 80, strict=True))


def test_notes_are_found_once(spark):
    """segment_and_align reads the notes it finds twice but finds them once."""
    from pathlib import Path

    import pytest

    from ostinato.plans import analysis

    folder = Path("/root/testdata/sf0.001")
    if not folder.exists():
        pytest.skip("no test tables")
    plan = analysis.segment_and_align(spark, str(folder))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInPandas") == 1  # the alignment


def test_greedy_pairs():
    x, y = np.array([0.0, 1.0, 5.0]), np.array([0.9, 1.2, 9.0])
    assert sequences.greedy_pairs(x, y, 2.0) == [(1, 0), (0, 1)]
    assert sequences.greedy_pairs(x, y, 0.05) == []


def test_tuning_shift():
    assert sequences.best_shift([60, 62, 64], [59.3, 61.3, 63.3], [round(i / 10, 6) for i in range(-20, 21)])[0] == 0.2


def test_signals_of_a_sine():
    rate, f, a = 8000, 220.0, 0.5
    x = a * np.sin(2 * np.pi * f * np.arange(rate) / rate)
    assert np.allclose(signals.rms(x, 1024, 512), a / np.sqrt(2), rtol=0.02)
    assert np.allclose(signals.yin(x, rate, 1024, 512, 60, 1500), f, rtol=0.005)
    assert np.allclose(signals.centroid(x, rate, 1024, 512), f, rtol=0.05)
    h = signals.harmonics(x, rate, np.full(20, f), 1024, 512, 2)
    assert np.allclose(np.abs(h[:, 0]), a, rtol=0.01) and np.abs(h[:, 1]).max() < 0.01
    assert len(signals.low_pass(x, 100)) == 80


def test_delay_is_found():
    x = np.random.default_rng(0).normal(size=16384)
    assert signals.correlation_delay(x[3000:4024], x)[0] == 3000
    assert signals.correlation_delay(x[100:], x[:-100] * 1.0)[0] == 100


def test_find_peaks():
    x = np.array([0, 3, 1, 2, 2, 1, 5, 0], dtype=float)
    assert signals.find_peaks(x).tolist() == [1, 3, 6]
    assert signals.find_peaks(x, prominence=1.5).tolist() == [1, 6]
    assert signals.find_peaks(x, distance=3).tolist() == [1, 6]
    assert signals.find_peaks(x, height=3).tolist() == [1, 6]


def test_segmentation_finds_notes():
    t = np.arange(0, 3, 0.01)
    f0 = np.where(t < 1, 220.0, np.where(t < 2, 246.9, 293.7))
    ampl = np.ones_like(t)
    for edge in (1.0, 2.0):
        ampl[np.abs(t - edge) < 0.04] = 0.2
    ampl[:8] = ampl[-8:] = 0.01
    ampl[4], ampl[-4] = 0.001, 0.001
    n = segment.notes_of(t, f0, ampl, 0.1)
    assert np.allclose(n["start"].to_numpy()[1:], [1.0, 2.0], atol=0.06)
    assert n["round_pitch"].tolist() == [-12, -10, -7]


def test_attack_corner(spark):
    t = np.arange(0, 2, 0.01)
    db = np.where(t < 0.5, -60, np.minimum(-60 + (t - 0.5) * 300, 0.0))
    db = np.where(t > 1.5, np.maximum(-(t - 1.5) * 200, -60), db) + 0.0
    points = spark.createDataFrame([("a", float(x), float(10 ** (y / 20))) for x, y in zip(t, db, strict=True)], "file string, t double, v double")
    notes = spark.createDataFrame([("a", 1, 0.5, 1.6), ("b", 2, 0.0, 1.0), ("a", 3, 5.0, 6.0)], "file string, note_key long, start double, end double")
    rows = segment.attacks(points, notes, ["file"]).collect()
    assert [r["note_key"] for r in rows] == [1]  # the others have no points
    a = rows[0]
    assert abs(a["attack_corner"] - 0.7) < 0.02 and abs(a["attack_start"] - 0.5) < 0.03 and abs(a["release_corner"] - 1.5) < 0.02
    assert abs(a["attack_db"] - 60) < 1 and abs(a["median_slope"] - 300) < 10


def test_groups_stream_in_frames_that_dont_grow(spark):
    """Ten times as many groups: the frames that Python holds are as large as before, and every group comes whole."""
    from ostinato.operators.grouped import per_group, streamed

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    try:
        largest = {}
        for n in (300, 3000):
            df = spark.range(n * 20).selectExpr(f"nullif(id % {n}, 7) k", "id v")
            got = streamed(df, ["k"], lambda g, starts: pd.DataFrame({"rows": [len(g)], "groups": [len(starts)]}), "rows long, groups long").agg({"rows": "max", "groups": "sum"}).first()
            largest[n] = got["max(rows)"]
            assert got["sum(groups)"] == n
            counts = per_group(df, ["k"], lambda g: pd.DataFrame({"n": [len(g)], "d": [g["v"].nunique()]}), "n long, d long").collect()
            assert len(counts) == n and {(r["n"], r["d"]) for r in counts} == {(20, 20)} and any(r["k"] is None for r in counts)
        assert largest[3000] <= 1100
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_long_track_in_parts_as_whole(spark, monkeypatch):
    rng = np.random.default_rng(4)
    n = 1500
    x = np.cumsum(rng.normal(0, 0.3, (n, 2)), axis=0) + 100
    df = spark.createDataFrame([("v", 1, float(i), i, float(p[0]), float(p[1])) for i, p in enumerate(x)], "video string, marker int, msec double, mark_id long, x double, y double")
    whole = {r["mark_id"]: (r["smooth_x"], r["smooth_y"]) for r in video.smooth_marks(df, ["video", "marker"], "msec", "mark_id").collect()}
    monkeypatch.setattr(video, "TRACK_ROWS", 500)
    monkeypatch.setattr(video, "TRACK_HALO", 200)
    parts = {r["mark_id"]: (r["smooth_x"], r["smooth_y"]) for r in video.smooth_marks(df, ["video", "marker"], "msec", "mark_id").collect()}
    assert whole.keys() == parts.keys() and len(whole) == n
    # The first rows are drawn to the mean of their part.
    assert max(abs(whole[k][0] - parts[k][0]) for k in whole if k >= 40) < 1e-6


def test_greedy_corners(spark):
    rng = np.random.default_rng(5)
    rows = [(f, i % 2, i, float(rng.integers(0, 9)), float(rng.integers(0, 9))) for f in range(6) for i in range(9)] + [(9, 0, 1, 1.0, 1.0), (None, 0, 1, 1.0, 1.0), (None, 1, 2, 4.0, 5.0)]
    df = spark.createDataFrame(rows, "frame int, side int, id long, x double, y double")
    got = {(r["frame"], r["left"], r["right"], r["distance"]) for r in sequences.greedy_corners(df, ["frame"], "side", "id", "x", "y").collect()}
    want = set()
    for f in {r[0] for r in rows}:
        a, b = ([r for r in rows if r[0] == f and r[1] == s] for s in (0, 1))
        while a and b:
            d, p, q = min((float(np.hypot(p[3] - q[3], p[4] - q[4])), p[2], q[2]) for p in a for q in b)
            want.add((f, p, q, d))
            a, b = [r for r in a if r[2] != p], [r for r in b if r[2] != q]
    assert got == want


def test_kalman_bridges_and_drops_outliers():
    n = np.arange(60)
    z = np.stack([2.0 * n, 100 - n], axis=1).astype(float)
    noisy = z + np.random.default_rng(0).normal(0, 0.2, z.shape)
    noisy[20:25] = np.nan
    noisy[40] = [900, 900]
    short = np.concatenate([noisy[:30], np.full((30, 2), np.nan)])
    many, outliers = video.smooth_tracks(np.stack([noisy, short]))
    got, out = many[0], outliers[0]
    alone, _ = video.smooth_tracks(noisy[None, :30])
    assert np.allclose(many[1, :30], alone[0])  # shorter tracks aren't changed by longer ones
    assert out.nonzero()[0].tolist() == [40]
    assert np.abs(got - z)[3:].max() < 2.0
    assert np.isnan(video.kalman_smooth(np.full((1, 3, 2), np.nan))).all()


def test_robust_line():
    t = np.arange(10.0)
    y = 2 * t + 1
    y[3] = 500
    assert np.allclose(video.robust_line(t, y), (2, 1))
