import datetime as dt
import shutil

import numpy as np
from pyspark.sql import functions as F

from ostinato.operators import video
from ostinato.sources import wav
from ostinato.streaming import regions


def source(spark, tmp_path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    return spark.readStream.schema(schema).parquet(str(tmp_path / "in"))


def drain(df, tmp_path, mode="append"):
    q = df.writeStream.format("memory").queryName("drained").outputMode(mode).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table("drained").collect()


def at(seconds):
    return dt.datetime(2031, 1, 1) + dt.timedelta(seconds=seconds)


def test_session_regions_as_batch(spark, tmp_path):
    rows = [("a", at(s)) for s in (0, 0.2, 0.4, 2.0, 2.1, 9.0)] + [("b", at(1.0)), ("z", at(1000))]
    stream = regions.session_regions(source(spark, tmp_path, rows, "key string, ts timestamp"), "ts", "key", "500 milliseconds", "1 second")
    got = sorted((r["key"], r["n"]) for r in drain(stream, tmp_path))
    batch = regions.session_regions(spark.createDataFrame(rows, "key string, ts timestamp"), "ts", "key").filter("key <> 'z'")
    assert got == sorted((r["key"], r["n"]) for r in batch.collect()) == [("a", 1), ("a", 2), ("a", 3), ("b", 1)]


def test_hopping_frames(spark, tmp_path):
    rows = [("a", at(s / 10), float(s)) for s in range(20)] + [("z", at(1000), 0.0)]
    got = drain(regions.hopping_frames(source(spark, tmp_path, rows, "key string, ts timestamp, v double"), "ts", "key", "v", late="1 second"), tmp_path)
    full = {r["start"]: r["mean"] for r in got if r["key"] == "a" and r["n"] == 10}
    assert full[at(0)] == 4.5 and full[at(0.5)] == 9.5


def test_running_maximum(spark, tmp_path):
    rows = [("a", float(v)) for v in (1, 3, 2, 3, 5)]
    got = drain(regions.running_maximum(source(spark, tmp_path, rows, "key string, v double"), "key", "v"), tmp_path)
    assert sorted(r["v"] for r in got) == [1.0, 3.0, 5.0]


def test_forgetting_tracker(spark, tmp_path):
    rows = [("m", float(t), v) for t, v in ((0, 7.0), (0.5, None), (1.0, None), (1.6, None), (2.0, 9.0))]
    df = source(spark, tmp_path, rows, "key string, t double, v double").withColumn("v", F.col("v"))
    got = sorted((r["t"], r["v"], r["held"]) for r in drain(regions.forgetting_tracker(df, "key", "t", "v", 1.0), tmp_path))
    assert got == [(0.0, 7.0, False), (0.5, 7.0, True), (1.0, 7.0, True), (1.6, None, False), (2.0, 9.0, False)]


def test_kalman_forward_as_the_first_pass_of_the_smoother(spark, tmp_path):
    rng = np.random.default_rng(2)
    rows = [("m", float(i), float(3 * i + rng.normal()) if i % 7 else None, float(100 - i)) for i in range(1, 60)]
    got = {r["t"]: (r["x"], r["y"]) for r in drain(regions.kalman_forward(source(spark, tmp_path, rows, "key string, t double, x double, y double"), "key", "t"), tmp_path)}
    m = p = None
    for _, t, x, y in rows:
        m, p = video.forward_step(m, p, np.array([x, y]) if x is not None else None)
        assert got[t] == (m[0], m[1])
    assert abs(m[0] - 3 * 59) < 3 and abs(m[3] + 1) < 0.5


def test_a_batch_that_is_run_again_replaces_itself(spark, tmp_path):
    rows = [("a", 1.0), ("b", 2.0)]
    folder = str(tmp_path / "out")
    df = source(spark, tmp_path, rows, "key string, v double")
    assert regions.drained(df, folder).count() == 2
    shutil.rmtree(f"{folder}/progress/commits")  # as if lost after it was written
    assert regions.drained(df, folder).count() == 2


def test_audio_blocks_as_a_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.wav").write_bytes(wav.encode(np.sin(np.arange(5000) / 20), 1000))
    got = drain(regions.audio_blocks(spark, str(tmp_path / "in"), 2048, 16), tmp_path)
    assert sorted((r["block"], r["own"], len(r["samples"])) for r in got) == [(0, 2048, 2064), (1, 2048, 2064), (2, 904, 904)]
