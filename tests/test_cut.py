"""Marks are cut to takes with every usable delay, and with the best one of each pair of files."""

from ostinato.plans import analysis

DELAYS = [  # video, signal, delay as typed, frac; in seconds: the second row is the best of a, none is usable for e
    ("a.mov", "x.wav", "1.0", 0.5, 1.0),
    ("a.mov", "x.wav", "2500 ms", 0.9, 2.5),
    ("b.mov", "x.wav", "3,5", 0.9, 3.5),
    ("c.mov", "x.wav", "\u22120.5 s", 0.9, -0.5),
    ("d.mov", "x.wav", "0.1 min", None, 6.0),
    ("e.mov", "x.wav", "unknown", 0.9, None),
]


def test_every_way_to_write_a_delay_is_used(spark, tmp_path):
    d = str(tmp_path)
    spark.createDataFrame([r[:4] for r in DELAYS], "video_file string, signal_file string, video_to_signal_delay string, frac double").write.parquet(f"{d}/wav_video_delays.parquet")
    marks = [(10 * i + j, f"{v}.mov", 1000.0 * j, 1, [0, 0, 1, 1], "x", 1.0) for i, v in enumerate("abcde") for j in range(10)]
    spark.createDataFrame(marks, "mark_id long, video_file string, msec double, marker_id int, bbox array<int>, source string, template_val double").write.parquet(f"{d}/video_marks.parquet")
    takes = [(1, "X.wav", 1, "t", "lab", 1, 2.0, 7.25), (2, "X.wav", 2, "t", "lab", 1, 7.25, 30.0), (3, "y.wav", 1, "t", "lab", 1, 0.0, 99.0)]
    spark.createDataFrame(takes, "ver_id int, wavfile string, ver_nbr int, tune string, instrument string, subject_id int, vers_start double, vers_end double").write.parquet(f"{d}/versions.parquet")
    best = {"a.mov": 2.5, "b.mov": 3.5, "c.mov": -0.5, "d.mov": 6.0}
    want = {(m[0], k[0], round(m[2] / 1000 + best[m[1]] - k[6], 6)) for m in marks if m[1] in best for k in takes[:2] if k[6] < m[2] / 1000 + best[m[1]] < k[7]}
    for query in (analysis.cut_to_recording, analysis.cut_to_recording_any_delay):
        assert {tuple(r) for r in query(spark, d).select("mark_id", "ver_id", "t").collect()} == want
