import math

import numpy as np
from pyspark.sql import functions as F

from ostinato.operators import hotdeck
from ostinato.operators.hotdeck import Field, Plan, hot_deck

NOTES = (
    "note_key long, wavfile string, ver_nbr int, ver_name string, note_id int, note_label string, tune string, subject_id int, instrument string,"
    "note_start double, note_end double, sound_start double, sound_end double, f0_avg double, f0_var double, ext_ampl_avg double, ext_ampl_var double, key long, level int"
)


def notes(n=200):
    rng = np.random.default_rng(1)
    out = []
    for i in range(n):
        pitch = i % 8
        out.append(
            [i, f"/a/Lab/x_{i // 20}.wav", i // 10 % 2, "serene", pitch, f"{pitch}(1) - C{pitch}", "reel", i // 50, "lab" if i // 20 % 2 else "own",
             float(i), i + 0.5, i + 0.1, i + 0.4, 200.0 + 20 * pitch + rng.normal(), 1.0, 1.0 + 0.1 * (i // 20), 0.1, 0, 0]
        )
    return out


def test_stand_ins_are_filled_and_marked(spark):
    rows = notes()
    missing = {}
    for i, bad in zip(range(5, 200, 13), [None, math.nan, 0.0, -1.0, -999.0, 99999.0] * 4, strict=False):
        rows[i][13] = bad
        missing[(i, "f0_avg")] = 200.0 + 20 * (i % 8)
    for i, bad in zip(range(3, 200, 29), [None, "", "  ", "unknown", "n/a", "?", "-"], strict=False):
        missing[(i, "instrument")] = rows[i][8]
        rows[i][8] = bad
    rows[50][8] = "LAB" if rows[50][8] == "lab" else "Own"
    rows.append(list(rows[5]))
    rows.append([None] * 19)
    got = {(r["note_key"], r["field"]): r for r in hotdeck.fill_notes(spark.createDataFrame(rows, NOTES)).collect()}
    assert set(got) == set(missing)
    for k, want in missing.items():
        assert got[k]["n_donors"] == 5
        if k[1] == "f0_avg":
            assert abs(got[k]["number"] - want) < 5
        else:
            assert got[k]["category"] == want


def test_empty_and_no_donor(spark):
    assert hotdeck.fill_notes(spark.createDataFrame([], NOTES)).count() == 0
    row = notes(1)[0]
    row[13] = None
    got = hotdeck.fill_notes(spark.createDataFrame([row], NOTES)).collect()
    assert [(r["field"], r["number"], r["n_donors"]) for r in got] == [("f0_avg", None, 0)]


def test_hot_block_is_split_and_still_whole(spark):
    df = spark.range(12_000).select(F.col("id").alias("k"), F.lit("one").alias("g"), (F.col("id") % 97).cast("double").alias("x"))
    df = df.withColumn("y", F.when(F.col("k") % 3 != 0, F.col("x") * 2))
    plan = Plan({"y": Field(F.col("y"), [["g"]])}, numbers=["x"], rank_by="x")
    got = hot_deck(df, "k", plan)
    assert got.count() == 4000
    off = got.join(df.select(F.col("k").alias("key"), "x"), "key").filter(F.abs(F.col("number") - 2 * F.col("x")) > 4).count()
    assert off < 40


def test_ties_and_nearest_as_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(i, float(rng.integers(0, 5)), float(i) if i % 4 else None) for i in range(60)]
    df = spark.createDataFrame(rows, "k long, x double, y double")
    plan = Plan({"y": Field(F.col("y"), [[]])}, numbers=["x"])
    got = {r["key"]: r for r in hot_deck(df, "k", plan).collect()}
    scale = df.agg(F.percentile_approx("x", [0.25, 0.75], 1000)).first()[0]
    scale = (scale[1] - scale[0]) or 1.0
    donors = [r for r in rows if r[2] is not None]
    for k, x, y in rows:
        if y is None:
            near = sorted(donors, key=lambda d: (min(abs(d[1] - x) / scale, 8), d[0]))[:5]
            assert list(got[k]["donors"]) == [d[0] for d in near]


def test_hot_block_is_searched_whole(spark):
    """The donors that are nearest by z lie anywhere in x, by which a hot block was cut into parts."""
    rng = np.random.default_rng(7)
    n = 6000
    x, z = rng.normal(size=n), rng.integers(0, 400, size=n) / 400
    rows = [(i, "one", float(x[i]), float(z[i]), float(rng.normal()) if i % 20 else None) for i in range(n)]
    df = spark.createDataFrame(rows, "k long, g string, x double, z double, y double")
    plan = Plan({"y": Field(F.col("y"), [["g"]])}, numbers=["z"], rank_by="x")
    got = {r["key"]: list(r["donors"]) for r in hot_deck(df, "k", plan).collect()}
    q = df.agg(F.percentile_approx("z", [0.25, 0.75], 1000)).first()[0]
    keys = np.array([i for i in range(n) if i % 20])
    want = {i: keys[np.lexsort((keys, np.abs(z[keys] / (q[1] - q[0]) - z[i] / (q[1] - q[0]))))[:5]].tolist() for i in range(0, n, 20)}
    assert got == want


def test_parts_are_even_and_leave_no_recipient_without_donors(spark, monkeypatch):
    """All donors of a hot block share a duration; its recipients have another or none."""
    search = hotdeck._search_part

    def bounded(numbers, categories, ask, first, count):
        assert max(np.unique(first, return_counts=True)[1].max(), count.max()) < 700
        return search(numbers, categories, ask, first, count)

    monkeypatch.setattr(hotdeck, "BLOCK_ROWS", 500)
    monkeypatch.setattr(hotdeck, "_search_part", bounded)
    rows = [(i, "hot", 1.0, 7.0) for i in range(4000)] + [(i, "hot", None if i % 2 else 0.0, None) for i in range(4000, 6000)]
    rows += [(i, f"cold{i}", i / 8000, 1.0) for i in range(6000, 14000)]
    df = spark.createDataFrame(rows, "k long, g string, x double, y double")
    got = hot_deck(df, "k", Plan({"y": Field(F.col("y"), [["g"]])}, numbers=["x"], rank_by="x")).collect()
    assert len(got) == 2000
    assert {(r["number"], tuple(r["donors"])) for r in got} == {(7.0, (0, 1, 2, 3, 4))}


def test_hot_block_of_many_donors_as_brute_force(spark):
    """A third of all rows in one block, 60,000 donors: the nearest five of each recipient, whatever part they are in."""
    n = 90_000
    df = spark.range(n).selectExpr("id k", "if(id % 3 < 2, 'hot', cast(id % 1000 as string)) g", "rand(5) x", "cast(floor(rand(6) * 4) as int) c", "if(id % 600 = 0, null, rand(7)) y").persist()
    got = {r["key"]: r for r in hot_deck(df, "k", Plan({"y": Field(F.col("y"), [["g"]])}, numbers=["x"], categories=["c"])).collect()}
    rows = df.collect()
    q = df.agg(F.percentile_approx("x", [0.25, 0.75], 1000)).first()[0]
    hot = [r for r in rows if r["g"] == "hot" and r["y"] is not None]
    x, c, k = (np.array([r[f] for r in hot]) for f in ("x", "c", "k"))
    asked = [r for r in rows if r["y"] is None]
    assert len(got) == len(asked) == 150
    for r in asked:
        d = np.abs(x / (q[1] - q[0]) - r["x"] / (q[1] - q[0])) + (c != r["c"])
        assert got[r["k"]]["donors"] == k[np.lexsort((k, d))[:5]].tolist()
    df.unpersist()


def test_masked_values_come_back(spark):
    """Known frequencies taken away from the notes of the small tables: the filled ones are as near as donors of one note are."""
    import os

    folder = "/root/testdata/sf0.01"
    if not os.path.exists(folder):
        return
    n = spark.read.parquet(f"{folder}/notes.parquet")
    known = F.col("f0_avg").between(60, 1600) & (F.pmod(F.xxhash64("note_key"), F.lit(20)) == 0)
    masked = n.withColumn("f0_avg", F.when(~known, F.col("f0_avg")))
    got = hotdeck.fill_notes(masked).filter("field = 'f0_avg' AND n_donors > 0").join(n.filter(known).select("note_key", F.col("f0_avg").alias("was")).distinct(), "note_key")
    cents = got.agg(F.percentile(F.abs(1200 * F.log2(F.col("number") / F.col("was"))), F.array(F.lit(0.5), F.lit(0.95))).alias("q")).first()["q"]
    assert cents[0] < 8 and cents[1] < 40
