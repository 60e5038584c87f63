import numpy as np
import pytest
from pyspark.sql import functions as F

from ostinato.operators import blocks, derive, stats, windows


def frame(spark, values, key="a"):
    return spark.createDataFrame([(key, i, None if v is None else float(v)) for i, v in enumerate(values)], "key string, i int, v double")


def test_crossings(spark):
    got = windows.crossings(frame(spark, [0, 2, 2, 0, 3, 3]), ["key"], ["i"], "v", 1.0).orderBy("i").collect()
    assert [(r["i"], r["direction"]) for r in got] == [(1, "up"), (3, "down"), (4, "up")]


@pytest.mark.parametrize("width", [1, 7, 8192])
@pytest.mark.parametrize("gap", [1, 3])
def test_islands_as_loop(spark, gap, width):
    mask = np.random.default_rng(gap).random(200) < 0.4
    want, current, idle = [], None, 0
    for i, on in enumerate(mask):
        if on:
            if current is None or idle >= gap:
                if current:
                    want.append(current)
                current = [i, i]
            current[1], idle = i, 0
        elif current is not None:
            idle += 1
    want.append(current)
    df = frame(spark, mask.astype(float))
    got = windows.islands(df, ["key"], ["i"], F.col("v") > 0, gap, width).orderBy("island").collect()
    assert [[r["first_i"], r["last_i"]] for r in got] == want


def test_median_filter_pads_with_zeros(spark):
    x = [5, 1, 4, 9, 2]
    got = [r["m"] for r in windows.median_filter(frame(spark, x), ["key"], ["i"], "v", 1, "m").orderBy("i").collect()]
    assert got == [1, 4, 4, 4, 2]


def test_forget(spark):
    df = frame(spark, [1, None, None, None, 2, None])
    got = [r["m"] for r in windows.forget_fill(df, ["key"], ["i"], "v", 2, "m", width=2).orderBy("i").collect()]
    assert got == [1, 1, 1, None, 2, 2]


def test_running_maximum_is_order_free(spark):
    v = np.random.default_rng(5).random(300)
    df = frame(spark, v).withColumn("block", F.floor(F.col("i") / 50))
    top = max(np.percentile(v[k * 50 : k * 50 + 50], 99) for k in range(6))
    assert windows.above_running_maximum(df, ["key"], "block", "v").count() == int((v >= top).sum())


def test_base_stats_against_numpy(spark):
    rng = np.random.default_rng(2)
    t, v = np.sort(rng.random(50)), rng.random(50).round(6)
    df = spark.createDataFrame([(1, float(a), float(b), 0.0, 1.0) for a, b in zip(t, v, strict=True)], "k int, t double, v double, start double, end double")
    r = stats.base_stats(df, ["k"]).first()
    assert r["avg"] == pytest.approx(np.median(v)) and r["var"] == pytest.approx(np.subtract(*np.percentile(v, [75, 25])))
    assert r["trend"] == pytest.approx(np.polyfit(t, v, 1)[0]) and r["max_t"] == t[v.argmax()] and r["min_v"] == v.min()
    for i in range(3):
        assert r[f"t{i + 1}"] == pytest.approx(v[(t >= i / 3) & (t < (i + 1) / 3)].mean())


def test_weighted_quantiles_against_numpy(spark):
    rng = np.random.default_rng(4)
    v, w = rng.random(21), rng.random(21)
    by = v.argsort()
    pos = (np.cumsum(w[by]) - w[by] / 2) / w.sum()
    df = spark.createDataFrame([("a", i, float(a), float(b)) for i, (a, b) in enumerate(zip(v, w, strict=True))], "key string, i int, v double, w double")
    r = stats.weighted_quantiles(df, ["key"], "v", "w", (0.0, 0.25, 0.5, 1.0), "i").first()
    assert [r["q00"], r["q25"], r["q50"], r["q100"]] == pytest.approx(np.interp([0, 0.25, 0.5, 1], pos, v[by]).tolist())


def test_local_tempo_of_even_notes(spark):
    df = spark.createDataFrame([("a", i, 0.5 * i, 0.5 * i + 0.5) for i in range(12)], "take string, n int, start double, end double")
    got = derive.local_tempo(df, ["take"], "n", 1.0).collect()
    assert len(got) == 12 and all(r["tempo"] == pytest.approx(120) and r["own_tempo"] == pytest.approx(120) for r in got)


def test_modes_and_missing_spread(spark):
    df = frame(spark, [3, 3, 3])
    assert [r["normal"] for r in stats.normalised(df, ["key"], "v", "minmax").collect()] == [None] * 3
    with pytest.raises(ValueError):
        stats.normalised(df, ["key"], "v", "other")


@pytest.mark.parametrize("width", [1, 3, 100])
def test_parts_change_nothing(spark, monkeypatch, width):
    monkeypatch.setattr(blocks, "ROWS", width + 2)
    rng = np.random.default_rng(width)
    rows = [(k, int(i), None if rng.random() < 0.3 else float(rng.integers(0, 4))) for k in "ab" for i in np.sort(rng.choice(200, 60, replace=False))]
    df = spark.createDataFrame(rows, "key string, i int, v double")
    w = windows.ordered(["key"], "i")
    plain = df.select(
        "key", "i", F.lag("v").over(w).alias("b"), F.last("v", ignorenulls=True).over(w.rowsBetween(-1000, 0)).alias("l"), F.first("v", ignorenulls=True).over(w.rowsBetween(0, 1000)).alias("f"), F.row_number().over(w).alias("n"), F.max("v").over(w.rowsBetween(-2, 2)).alias("m")
    )
    x = blocks.parted(df, "i", width)
    packed = F.when(F.col("v").isNotNull(), F.struct("v"))
    x = blocks.neighbour(x, ["key"], ["i"], F.struct("v"), "b")
    x = blocks.known(blocks.known(x, ["key"], ["i"], packed, "l"), ["key"], ["i"], packed, "f", after=True)
    x = blocks.running_total(x, ["key"], ["i"], F.lit(1), "n").select("key", "i", "b.v", "l.v", "f.v", "n")
    assert sorted(map(repr, (tuple(r) for r in x.collect()))) == sorted(map(repr, (tuple(r)[:6] for r in plain.collect())))
    h, hw = blocks.with_halo(df, ["key"], ["i"], 2, width)
    h = h.withColumn("m", F.max("v").over(hw.rowsBetween(-2, 2))).filter("own")
    assert sorted(map(repr, ((r["key"], r["i"], r["m"]) for r in h.collect()))) == sorted(map(repr, ((r["key"], r["i"], r["m"]) for r in plain.collect())))
