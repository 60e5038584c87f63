import math

import numpy as np
import pytest

from ostinato.operators import faults

READ = "series_id long, frame_idx int, label string, t double, v double, lo double, core string"
LIMITS = "label string, lo double, hi double, v double"


def series(n, seed, level=100.0):
    rng = np.random.default_rng(seed)
    notes = np.repeat(rng.choice([level, level * 1.2, level * 0.8], n // 40 + 1), 40)[:n]
    return notes + rng.normal(0, 1, n)


def rows(sid, v, label="f0"):
    return [(sid, i, label, 0.01 * i, None if x is None else float(x), 0.0, "") for i, x in enumerate(v)]


@pytest.fixture(scope="module")
def planted(spark):
    data, truth = [], {}
    for sid in range(30):
        v = series(600, sid)
        for at in (35, 137, 301, 420):
            v[at] += 40
            truth[(sid, at)] = "spike"
        v[200:230] = v[200]
        truth |= {(sid, i): "still" for i in range(200, 230)}
        v[500] = -9999
        truth[(sid, 500)] = "range"
        data += rows(sid, v)
    data += [(1, 7, "f0", 0.07, data[607][4], 0.0, ""), (2, None, "f0", 0.0, 1.0, 0.0, ""), (None, 1, "f0", 0.0, 1.0, 0.0, ""), (3, 900, "f0", None, None, 0.0, ""), (3, 901, "f0", None, math.nan, 0.0, "")]
    limits = spark.createDataFrame([("f0", 0.0, 1000.0, 0.0), (None, 0.0, 1.0, 0.0)], LIMITS)
    return faults.flag_faults(spark.createDataFrame(data, READ), limits).collect(), truth


def test_finds_what_is_planted(planted):
    found, truth = planted
    got = {(r["series_id"], r["frame_idx"]): r["reason"] for r in found}
    hit = sum(got.get(k) == reason for k, reason in truth.items())
    assert hit >= 0.97 * len(truth)
    assert len(set(got) - set(truth)) <= 0.02 * len(truth)
    assert not any(sid is None or f is None for sid, f in got)


def test_blocks_dont_matter(spark, monkeypatch):
    data = []
    for sid in range(3):
        v = series(3000, sid)
        v[1500:1540] = v[1500]
        v[1023] += 60
        data += rows(sid, v)
    limits = spark.createDataFrame([("f0", 0.0, 1000.0, 0.0)], LIMITS)
    df = spark.createDataFrame(data, READ)
    whole = {(r[0], r[1], r[3]) for r in faults.flag_faults(df, limits).collect()}
    monkeypatch.setattr(faults, "BLOCK", 512)
    parts = {(r[0], r[1], r[3]) for r in faults.flag_faults(df, limits).collect()}
    assert {k for k in whole if k[2] == "still"} == {k for k in parts if k[2] == "still"}
    assert all((s, 1023, "spike") in parts for s in range(3))


def test_two_state_is_never_still(spark):
    data = rows(1, [0.0] * 200 + [1.0] * 200 + [2.0], "tongue_contact") + rows(2, [5.0] * 300, None)
    limits = spark.createDataFrame([("tongue_contact", 0.0, 1.0, 0.0)], LIMITS)
    got = faults.flag_faults(spark.createDataFrame(data, READ), limits).collect()
    assert [(r["series_id"], r["frame_idx"]) for r in got if r["series_id"] == 1] == [(1, 400)]
    assert sum(r["series_id"] == 2 for r in got) == 300  # a label without limits is still scored


def test_empty(spark):
    assert faults.flag_faults(spark.createDataFrame([], READ), spark.createDataFrame([], LIMITS)).count() == 0


def test_tail_cutoff_ignores_faults():
    rng = np.random.default_rng(0)
    z = rng.exponential(0.5, 100_000)
    edges = np.arange(int(faults.CENSOR / faults.BIN)) * faults.BIN
    counts = np.histogram(z, bins=np.append(edges, np.inf))[0].astype(float)
    beyond = int((z >= faults.CENSOR).sum())
    counts[-1] -= beyond
    clean = faults.tail_cutoff(counts, beyond)
    dirty = faults.tail_cutoff(counts, beyond + 500)
    assert clean == pytest.approx(0.5 * math.log(1 / faults.RISK), rel=0.25)
    assert dirty == pytest.approx(clean, rel=0.1)


@pytest.mark.parametrize("n, length", [(24_000, 500), (24_000, 3000), (24_000, 6500), (24_000, 8192), (110_000, 50_000)])
def test_a_noisy_stretch_of_any_length_stands_still(spark, n, length):
    rng = np.random.default_rng(length)
    v = 100 + rng.normal(0, 1, n)
    v[9000 : 9000 + length] = v[9000] + rng.normal(0, 1e-4, length)
    df = spark.createDataFrame([(1, i, "f0", 0.01 * i, float(x), 0.0, "") for i, x in enumerate(v)], READ)
    got = faults.flag_faults(df, spark.createDataFrame([("f0", 0.0, 1000.0, 0.0)], LIMITS)).filter("reason = 'still'").collect()
    assert {r["frame_idx"] for r in got} == set(range(9000, 9000 + length))


def test_a_missing_time_hides_no_spike(spark):
    v = series(600, 5)
    v[300] += 12
    data = rows(1, v)
    plain = faults.flag_faults(spark.createDataFrame(data, READ), spark.createDataFrame([("f0", 0.0, 1000.0, 0.0)], LIMITS)).collect()
    for i, t in ((299, None), (301, math.nan)):
        data[i] = (1, i, "f0", t, data[i][4], 0.0, "")
    got = faults.flag_faults(spark.createDataFrame(data, READ), spark.createDataFrame([("f0", 0.0, 1000.0, 0.0)], LIMITS)).collect()
    assert [(r["frame_idx"], r["reason"]) for r in got] == [(r["frame_idx"], r["reason"]) for r in plain] == [(300, "spike")]
