import math
import random

import pytest

from ostinato.operators import grid

READ = "series_id long, frame_idx int, t double, v double, n_slots int, extra string"
HEAD = "series_id long, t0 double, dt double, n_slots int, t double"


def brute_gaps(readings, series):
    out = set()
    for s, t0, dt, n, _ in series:
        seen = {math.floor((t - t0) / dt + 0.5) for i, _, t, v, *_ in readings if i == s and t is not None and v is not None and t == t and v == v}
        out |= {(s, k) for k in range(n) if k not in seen}
    return out


@pytest.mark.parametrize("block", [4, 7, 4096])
def test_gaps_as_brute_force(spark, block):
    rng = random.Random(block)
    series = [(i, rng.random(), rng.choice([0.01, 0.5, 1.0]), rng.randint(1, 40), None) for i in range(8)]
    readings = []
    for s, t0, dt, n, _ in series[:-1]:
        for f in range(rng.randint(0, 50)):
            t = rng.choice([None, math.nan, t0 + dt * rng.uniform(-3, n + 3), t0 + dt * rng.randint(0, n)])
            readings.append((s, f, t, rng.choice([None, math.nan, 1.0, 1e300]), 5, "x"))
    readings += readings[:5] + [(None, 1, 1.0, 1.0, 1, ""), (99, 1, 1.0, 1.0, 1, "")]
    got = grid.uncovered_slots(spark.createDataFrame(readings, READ), spark.createDataFrame(series, HEAD), block).collect()
    assert len(got) == len(set(got))
    assert {tuple(r) for r in got} == brute_gaps(readings, series)


def test_level_grid_marks_gaps_and_averages_once(spark):
    series = spark.createDataFrame([(1, 0.0, 1.0, 4, 0.0), (2, 0.0, 0.0, 3, 0.0), (3, None, 1.0, 3, 0.0)], HEAD)
    readings = spark.createDataFrame([(1, 0, 0.1, 2.0, 0, ""), (1, 0, 0.1, 2.0, 0, ""), (1, 1, -0.2, 4.0, 0, ""), (1, 2, 2.5, 7.0, 0, "")], READ)
    rows = {r["slot"]: r for r in grid.level_grid(readings, series).collect()}
    assert sorted(rows) == [0, 1, 2, 3]
    assert rows[0]["v"] == 3.0 and rows[0]["n_readings"] == 2
    assert rows[1]["is_gap"] and rows[2]["is_gap"] and rows[3]["v"] == 7.0


@pytest.mark.parametrize("block", [3, 4096])
def test_counter_resets_overlap_and_gaps(spark, block):
    series = spark.createDataFrame([(1, 0.5, 1.0, 30, 0.0)], HEAD)  # cell k spans [k, k+1)
    # 10 over 2 s; a reset to 3; a gap of 20 cells that isn't shared; the same time twice.
    readings = [(1, 0, 0.5, 5.0, 0, ""), (1, 1, 2.5, 15.0, 0, ""), (1, 2, 3.5, 3.0, 0, ""), (1, 3, 24.0, 50.0, 0, ""), (1, 4, 24.0, 51.0, 0, ""), (1, 5, None, 1.0, 0, "")]
    rows = {r["slot"]: r for r in grid.counter_grid(spark.createDataFrame(readings, READ), series, max_gap=8, block=block).collect()}
    assert len(rows) == 30
    assert [rows[k]["increment"] for k in (0, 1)] == [pytest.approx(2.5), pytest.approx(5.0)]
    assert rows[2]["increment"] == pytest.approx(2.5 + 1.5) and rows[3]["increment"] == pytest.approx(1.5)
    assert sum(r["n_resets"] for r in rows.values()) == 1
    assert rows[10]["increment"] is None and rows[10]["covered"] == 0
    assert rows[24]["increment"] == pytest.approx(1.0)
    assert sum(r["increment"] or 0 for r in rows.values()) == pytest.approx(10 + 3 + 1)


def test_empty_tables(spark):
    none = spark.createDataFrame([], READ)
    one = spark.createDataFrame([(1, 0.0, 1.0, 2, 0.0)], HEAD)
    assert grid.uncovered_slots(none, one).count() == 2
    assert grid.level_grid(none, one).count() == 2
    assert grid.counter_grid(none, one).count() == 2
    assert grid.uncovered_slots(none, spark.createDataFrame([], HEAD)).count() == 0
