import random

import pytest

from ostinato.operators import intervals


def make(seed, n=60):
    rng = random.Random(seed)
    spans = [(k, i, s := rng.randint(0, 40) / 2, s + rng.randint(0, 12) / 2) for k in "ab" for i in range(n // 6)]
    pts = [(k, i, rng.randint(0, 100) / 4) for k in "ab" for i in range(n)]
    return pts, spans


@pytest.mark.parametrize("closed", ["both", "left", "right", "neither"])
@pytest.mark.parametrize("bucket", [0.7, 4.0])
def test_interval_join(spark, closed, bucket):
    pts, spans = make(1)
    p = spark.createDataFrame(pts, "key string, pid int, t double")
    s = spark.createDataFrame([*spans, ("a", 99, None, 1.0), ("a", 98, 5.0, 1.0)], "key string, sid int, start double, end double")
    got = sorted((r["key"], r["pid"], r["sid"]) for r in intervals.interval_join(p, s, ["key"], closed=closed, bucket=bucket).collect())
    low = (lambda t, a: t >= a) if closed in ("both", "left") else (lambda t, a: t > a)
    high = (lambda t, b: t <= b) if closed in ("both", "right") else (lambda t, b: t < b)
    assert got == sorted((k, i, j) for k, i, t in pts for q, j, a, b in spans if k == q and low(t, a) and high(t, b))


def test_left_join_keeps_points_once(spark):
    p = spark.createDataFrame([("a", 1, 1.0), ("a", 2, 50.0)], "key string, pid int, t double")
    s = spark.createDataFrame([("a", 1, 0.0, 2.0)], "key string, sid int, start double, end double")
    assert sorted((r["pid"], r["sid"]) for r in intervals.interval_join(p, s, ["key"], how="left").collect()) == [(1, 1), (2, None)]


def test_overlapping_once(spark):
    _, spans = make(2)
    x = spark.createDataFrame(spans, "key string, i int, start double, end double")
    y = x.selectExpr("key", "i AS j", "start AS other_start", "end AS other_end")
    got = sorted((r["key"], r["i"], r["j"]) for r in intervals.overlapping(x, y, ["key"], bucket=1.5).collect())
    assert got == sorted((k, i, j) for k, i, a, b in spans for q, j, c, d in spans if k == q and a < d and c < b)


@pytest.mark.parametrize("direction", ["backward", "forward"])
@pytest.mark.parametrize("strict", [False, True])
def test_asof(spark, direction, strict):
    pts, _ = make(3)
    marks = [(k, t, i) for k, i, t in make(4, 12)[0]]
    got = {(r["key"], r["pid"]): r["mark_t"] for r in intervals.asof(spark.createDataFrame(pts, "key string, pid int, t double"), spark.createDataFrame(marks, "key string, mark_t double, n int"), ["key"], ["n"], direction, strict).collect()}
    for k, i, t in pts:
        if direction == "backward":
            want = max((m for q, m, _ in marks if q == k and (m < t if strict else m <= t)), default=None)
        else:
            want = min((m for q, m, _ in marks if q == k and (m > t if strict else m >= t)), default=None)
        assert got[(k, i)] == want


def test_lerp(spark):
    p = spark.createDataFrame([("a", x) for x in (-1.0, 0.0, 0.5, 1.0, 3.0, 9.0)], "key string, t double")
    m = spark.createDataFrame([("a", 0.0, 1.0), ("a", 1.0, 3.0), ("a", 5.0, 7.0)], "key string, mark_t double, value double")
    got = {r["t"]: r["value"] for r in intervals.lerp(p, m, ["key"]).collect()}
    assert got == {-1.0: 1.0, 0.0: 1.0, 0.5: 2.0, 1.0: 3.0, 3.0: 5.0, 9.0: 7.0}


#: A documented example of a union with tolerance, what is exactly as far away being kept.
def test_tolerant_union_known_answers(spark):
    def union(x, y):
        a, b = (spark.createDataFrame([("k", float(v)) for v in s], "key string, t double") for s in (x, y))
        return sorted(r["t"] for r in intervals.tolerant_union(a, b, ["key"], 1.0).collect())

    assert union([0, 1, 2, 3], [0, 1.1, 5, 6]) == [0, 1, 2, 3, 5, 6]
    assert union([0, 0.5, 1, 2, 4], [-1.2, 0.7, 1.1, 3, 4.1]) == [-1.2, 0, 0.5, 1, 2, 3, 4]


def test_nearest_interval(spark):
    s = spark.createDataFrame([("a", 0.0, 1.0, "x"), ("a", 4.0, 5.0, "y")], "key string, start double, end double, name string")
    p = spark.createDataFrame([("a", t) for t in (-3.0, 0.5, 2.0, 2.5, 3.0, 4.5, 9.0)] + [("b", 1.0)], "key string, t double")
    got = {(r["key"], r["t"]): r["name"] for r in intervals.nearest_interval(p, s, ["key"], "name").collect()}
    assert got == {("a", -3.0): "x", ("a", 0.5): "x", ("a", 2.0): "x", ("a", 2.5): "x", ("a", 3.0): "y", ("a", 4.5): "y", ("a", 9.0): "y", ("b", 1.0): None}
