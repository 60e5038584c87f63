import math
import random

import numpy as np
import pytest

from ostinato.llm import nearest

LEFT = "entity string, t double, id long, right_id string"
RIGHT = "entity string, t double, id long, gap int"


def brute(left, right, tolerance):
    out = set()
    for e, t, i, _ in left:
        if e is None or t is None or i is None or t != t:
            continue
        near = [(abs(u - t), u, j) for f, u, j, _ in right if f == e and u is not None and u == u and j is not None]
        if near:
            gap, _, j = min((round(g, 9), u, j) for g, u, j in near)
            if gap <= tolerance:
                out.add((i, j))
    return out


@pytest.mark.parametrize("hot", [3, 50_000])
def test_as_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(nearest, "HOT", hot)
    rng = random.Random(hot)
    edge = nearest.SHARD_SECONDS
    times = lambda: rng.choice([rng.uniform(-70, 200), edge + rng.choice([-0.1, 0, 0.05]), 2 * edge, round(rng.uniform(0, 5), 1)])
    right = [(rng.choice("abc"), times(), i, 0) for i in range(300)]
    left = [(rng.choice("abcd"), times(), i, "") for i in range(300)]
    right += [right[0], (None, 1.0, 900, 0), ("a", None, 901, 0), ("a", math.nan, 902, 0), ("a", 1.0, None, 0), ("a", right[0][1], 903, 0)]
    left += [left[0], (None, 1.0, 900, ""), ("a", None, 901, ""), ("a", math.nan, 902, ""), ("a", 1.0, None, "")]
    got = nearest.nearest_in_time(spark.createDataFrame(left, LEFT), spark.createDataFrame(right, RIGHT), 0.15).collect()
    assert len(got) == len({r["left_id"] for r in got})
    assert {(r["left_id"], r["right_id"]) for r in got} == brute(left, right, 0.15)


def test_dense_right_side_is_split(spark, monkeypatch):
    """A third of the records at one entity and within one shard: no bucket holds more than its share."""
    rows = []
    n = 200_000
    match = nearest._match_bucket
    monkeypatch.setattr(nearest, "HOT", 5_000)
    monkeypatch.setattr(nearest, "ROWS_A_BUCKET", 10_000)
    right = spark.range(n).selectExpr("if(id % 3 = 0, 'hub', concat('e', id % 500)) entity", "1.0 + id * 0.0003 t", "id", "0 gap")
    left = spark.range(20_000).selectExpr("if(id % 3 = 0, 'hub', concat('e', id % 500)) entity", "1.00004 + id * 0.003 t", "id", "'' right_id")

    def counted(tolerance):
        run = match(tolerance)

        def bounded(data):
            assert data.num_rows < 40_000, data.num_rows
            return run(data)

        return bounded

    monkeypatch.setattr(nearest, "_match_bucket", counted)
    got = {(r["left_id"], r["right_id"]) for r in nearest.nearest_in_time(left, right, 0.15).collect()}
    times: dict[str, list] = {}
    for i in range(n):
        times.setdefault("hub" if i % 3 == 0 else f"e{i % 500}", []).append((1.0 + i * 0.0003, i))
    at = {key: np.array([x for x, _ in held]) for key, held in times.items()}
    for i in range(20_000):
        key, t = "hub" if i % 3 == 0 else f"e{i % 500}", 1.00004 + i * 0.003
        if key in at:
            lo = max(0, int(np.searchsorted(at[key], t)) - 2)
            ts = at[key][lo : lo + 4]
            gap = np.abs(ts - t)
            if gap.min() <= 0.15:
                rows.append((i, times[key][lo + int(np.argmin(np.round(gap, 9)))][1]))
    assert got == set(rows)


def test_equally_near_takes_the_earlier(spark):
    left = spark.createDataFrame([("a", 1.0, 1, "")], LEFT)
    right = spark.createDataFrame([("a", 1.1, 5, 0), ("a", 0.9, 7, 0), ("a", 0.9, 6, 0)], RIGHT)
    assert [(r["left_id"], r["right_id"]) for r in nearest.nearest_in_time(left, right, 0.15).collect()] == [(1, 6)]


def test_index_error_is_bounded():
    rng = np.random.default_rng(0)
    for keys in (np.sort(rng.random(5000) ** 3 * 1000), np.arange(100.0), np.array([1.0]), np.repeat([1.0, 2.0], 40)):
        first, slopes = nearest.pieces(keys)
        asked = np.concatenate([keys, rng.random(500) * keys.max() * 1.1 - 0.01])
        got = nearest.positions(keys, first, slopes, asked)
        assert (got == np.searchsorted(keys, asked, side="right")).all()


def test_best_delay_and_paths(spark):
    delays = spark.createDataFrame(
        [("/A/x.wav", "/a/v.MP4", "failed", 0.9), ("\\a\\X.WAV ", "/A/v.mp4", "-1.0", 0.2), ("/a/x.wav", "/a/v.mp4", "-2,0", 0.5), ("/a/y.wav", "/a/v.mp4", "-3000 ms", float("nan"))],
        "signal_file string, video_file string, video_to_signal_delay string, frac double",
    )
    assert {(r["signal"], r["delay"]) for r in nearest.best_delays(delays).collect()} == {("/a/x.wav", -2.0), ("/a/y.wav", -3.0)}
    marks = spark.createDataFrame([(1, "/a/V.mp4", 5000.0), (1, "/a/V.mp4", 5000.0)], "mark_id long, video_file string, msec double")
    notes = spark.createDataFrame([(7, "/a/x.wav", 3.1), (8, "/a/y.wav", 2.0), (8, "/a/y.wav", 2.0)], "note_key long, wavfile string, note_start double")
    assert sorted((r["mark_id"], r["note_key"]) for r in nearest.marks_to_notes(marks, delays, notes).collect()) == [(1, 7), (1, 8)]


def test_entities_that_differ_after_a_nul(spark):
    left = spark.createDataFrame([("a\x00b", 1.0, 1, ""), ("a\x00c", 2.0, 2, "")], LEFT)
    right = spark.createDataFrame([("a\x00c", 1.0, 5, 0), ("a\x00b", 1.1, 6, 0), ("a\x00c", 2.0, 7, 0)], RIGHT)
    assert sorted((r["left_id"], r["right_id"]) for r in nearest.nearest_in_time(left, right, 0.15).collect()) == [(1, 6), (2, 7)]


def test_empty(spark):
    none, one = spark.createDataFrame([], LEFT), spark.createDataFrame([("a", 1.0, 1, 0)], RIGHT)
    assert nearest.nearest_in_time(none, one, 0.1).count() == 0
    assert nearest.nearest_in_time(one.selectExpr("entity", "t", "id"), spark.createDataFrame([], RIGHT), 0.1).count() == 0
