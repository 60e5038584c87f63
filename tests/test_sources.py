import json

import numpy as np
from pyspark.sql import functions as F

from ostinato.operators import signals
from ostinato.sources import channels, metadata, textgrid, wav


def tone(rate=8000, seconds=1.0, hz=220.0):
    return np.sin(2 * np.pi * hz * np.arange(int(rate * seconds)) / rate)


def test_wav_round_trip_and_blocks(spark, tmp_path):
    (tmp_path / "a.wav").write_bytes(wav.encode(tone(), 8000))
    (tmp_path / "b.WAV").write_bytes(b"RIFFnothing")
    rows = wav.read_blocks(spark, str(tmp_path), block=3000, overlap=1024).orderBy("path", "block").collect()
    good = [r for r in rows if r["error"] is None]
    assert [(r["block"], len(r["samples"]), r["own"]) for r in good] == [(0, 4024, 3000), (1, 4024, 3000), (2, 2000, 2000)]
    assert len(rows) - len(good) == 1
    assert np.allclose(np.concatenate([r["samples"][: r["own"]] for r in good]), tone(), atol=1e-3)


def test_headers_and_rate(spark, tmp_path):
    content = wav.encode(tone(), 8000)
    (tmp_path / "a.wav").write_bytes(wav.with_rate(content, 44100))
    r = wav.headers(spark, str(tmp_path)).first()
    assert (r["rate"], r["bytes_a_second"]) == (44100, 88200)


def test_descriptors_dont_depend_on_blocks(spark, tmp_path):
    (tmp_path / "a.wav").write_bytes(wav.encode(tone(), 8000))
    got = {}
    for block in (2048, 1 << 18):
        d = signals.describe(wav.read_blocks(spark, str(tmp_path), block=block, overlap=1536), 1024, 512)
        got[block] = {(r["descriptor"], round(r["t"], 6)): round(r["v"], 4) for r in d.collect() if r["v"] is not None}
    assert got[2048].keys() == got[1 << 18].keys()
    wrapped = lambda x: abs((x + np.pi) % (2 * np.pi) - np.pi)
    loud = [k for k in got[2048] if not k[0].startswith(("h02", "h03", "h04", "h05"))]  # a tone has no other harmonics
    assert max(wrapped(got[2048][k] - got[1 << 18][k]) if "rarg" in k[0] else abs(got[2048][k] - got[1 << 18][k]) for k in loud) < 1e-2
    assert np.allclose([v for (d, _), v in got[2048].items() if d == "h01_freq"], 220, rtol=0.01)
    f0 = [v for (d, _), v in got[2048].items() if d == "f0"]
    assert np.allclose(f0, 220, rtol=0.01)


def test_calibration(spark, tmp_path):
    (tmp_path / "a.wav").write_bytes(wav.encode(tone(), 8000))
    dim = channels.channel_table(spark, {"default": [{"name": "barrel", "type": "pressure", "gain": 2.0, "offset": 1.0}]})
    r = wav.calibrated_blocks(wav.read_blocks(spark, str(tmp_path)), dim).first()
    assert r["name"] == "barrel" and abs(r["samples"][0] - 2.0) < 1e-3


def test_textgrid_round_trip(spark, tmp_path):
    spans = [("x/one.wav", "note", 0.5, 1.0, '1(1) - "C4"'), ("x/one.wav", "note", 1.0, 2.0, "2(1) - D♯4"), ("x/one.wav", "clip", 0.0, 2.0, "serene"), ("two", "note", 0.0, 1.0, "z")]
    df = spark.createDataFrame(spans, "path string, tier string, start double, end double, label string")
    textgrid.write_texts(textgrid.as_texts(df), str(tmp_path))
    text = (tmp_path / "two.TextGrid").read_text()
    (tmp_path / "two.TextGrid").write_bytes(text.encode("utf-16"))
    got = textgrid.read_intervals(spark, str(tmp_path)).collect()
    assert sorted((r["tier"], r["start"], r["end"], r["label"]) for r in got) == sorted(s[1:] for s in spans)
    picked = textgrid.pick_tier(textgrid.read_intervals(spark, str(tmp_path)), "cl").collect()
    assert [r["label"] for r in picked] == ["serene"]
    assert [r["label"] for r in textgrid.first_label_region(textgrid.read_intervals(spark, str(tmp_path)), r"\d\(1\)", 1).collect()] == ["2(1) - D♯4"]


def test_scores_have_two_kinds_of_numbers(spark):
    scores = {"reel": {"bar_duration": 4, "notes": [{"pitch": "C4", "duration": 1}, {"pitch": 0, "duration": 2}, {"pitch": "D4", "duration": 1, "strong_beat": True}]}}
    rows = metadata.beat_starts(metadata.score_table(spark, scores)).orderBy("score_idx").collect()
    assert [(r["score_idx"], r["note_id"], r["beat_start"]) for r in rows] == [(0, 0, 0.0), (1, None, 1.0), (2, 1, 3.0)]


def test_lists_runs_and_detections(spark, tmp_path):
    (tmp_path / "list.csv").write_text(",filename,tune,own,sensor_set,subject_id,channel_set,instrument\n0,/a.wav,,FALSE,1,2,default,lab\n")
    r = metadata.read_recordings(spark, str(tmp_path / "list.csv")).first()
    assert r["tune"] is None and r["own"] is False and r["filename"] == "/a.wav"
    runs = spark.sql("SELECT named_struct('subject', 7, 'channels', 'default') AS run, array(named_struct('filename', 'a', 'channels', cast(null AS string)), named_struct('filename', 'b', 'channels', 'x')) AS files")
    assert sorted((x["filename"], x["channels"], x["subject"]) for x in metadata.flatten_runs(runs).collect()) == [("a", "default", 7), ("b", "x", 7)]
    (tmp_path / "m.json").write_text(json.dumps({"msec": 40.0, "markers": {"3": {"bbox": [1, 2, 3, 4], "source": "aruco"}}}) + "\n" + json.dumps({"msec": 80.0, "markers": {}}))
    rows = metadata.read_detections(spark, str(tmp_path / "m.json")).orderBy("msec").collect()
    assert [(x["msec"], x["marker_id"]) for x in rows] == [(40.0, 3), (80.0, None)]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a_f0", 0.0, 1.0), (2, "a_f0", 0.0, 2.0)], "rec_id int, label string, t double, v double")
    metadata.write_series(df, str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).filter("rec_id = 2").first()["v"] == 2.0
    metadata.write_regions(df, str(tmp_path / "r"), "\t")
    assert spark.read.csv(str(tmp_path / "r"), sep="\t", header=True).count() == 2
    merged = metadata.merge_runs(df.select("rec_id"), df.filter("rec_id = 1").select("rec_id", F.col("t").alias("start"), F.col("v").alias("end"), "label"), ["rec_id"])
    assert {r["rec_id"]: len(r["regions"]) for r in merged.collect()} == {1: 1, 2: 0}
    both = metadata.assemble_series(df, df.withColumn("extra", F.lit(1)))
    assert both.count() == 4 and both.filter("extra IS NULL").count() == 2


def test_base_channel(spark):
    df = spark.createDataFrame([(1, "external"), (1, "barrel"), (2, "farfield"), (3, "reed")], "rec int, channel string")
    assert {r["rec"]: r["channel"] for r in channels.base_channel(df, ["rec"]).collect()} == {1: "barrel", 2: "farfield", 3: "farfield"}
