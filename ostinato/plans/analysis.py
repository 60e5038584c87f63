"""Queries on alignment, synchronisation, video and signals."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ostinato.functions import exprs
from ostinato.operators import intervals, segment, sequences, signals, stats, sync, video, windows
from ostinato.plans import views
from ostinato.plans.notes import _SCORE, _score
from ostinato.plans.registry import Registry
from ostinato.plans.series import _FRAMED, _HOP, _WINDOW, _framed
from ostinato.plans.views import B, H, K, M, N, P, R, path_sql, rounded
from ostinato.session import broadcast_if_small, checkpointed, path_key, shared_folder, table
from ostinato.streaming.regions import drained, session_regions

registry = Registry()


def _sql(text: str, *ctes: str) -> str:
    return "WITH " + ", ".join(ctes) + "\n" + text


# Alignment with scores


def _played(spark: SparkSession, d: str) -> DataFrame:
    n = views.notes(spark, d).filter("f0 IS NOT NULL")
    return n.select("file", "ver_nbr", "tune", F.struct("start", "note_key").alias("at"), F.col("note_key").alias("place"), exprs.semitones("f0").alias("semitones"))


def _takes_played(spark: SparkSession, d: str) -> DataFrame:
    """Notes of takes in order of time, with rounded MIDI pitch as written (two semitones above what sounds)."""
    x = _played(spark, d)
    place = F.row_number().over(windows.ordered(["file", "ver_nbr", "tune"], "at")).cast("long")
    return x.select("file", "ver_nbr", "tune", place.alias("place"), (F.rint(F.col("semitones") + 2) + 69).cast("long").alias("pitch"), (F.col("semitones") + 71).alias("exact"))


def _written(spark: SparkSession, d: str) -> DataFrame:
    return _score(spark, d).select("tune", F.col("note_id").cast("long").alias("place"), exprs.name_to_midi("pitch").cast("long").alias("pitch"))


@registry.query("nw_align")
def nw_align(spark: SparkSession, d: str) -> DataFrame:
    """Notes of each take against the score of its tune, repeated as often as fits best."""
    return sequences.align_takes(_takes_played(spark, d).drop("exact"), _written(spark, d), ["file", "ver_nbr"])


@registry.query("guess_repetitions")
def guess_repetitions(spark: SparkSession, d: str) -> DataFrame:
    """How often each take plays its score, and how many notes match it."""
    a = nw_align(spark, d)
    matched = F.count_if(F.col("score_place").isNotNull() & F.col("played_place").isNotNull())
    return a.groupBy("file", "ver_nbr").agg(F.max("repetition").alias("repetitions"), matched.alias("n_paired"), F.count("*").alias("n_rows"))


@registry.query("difflib_align")
def difflib_align(spark: SparkSession, d: str) -> DataFrame:
    """How many semitones each take is off its score, as the shift at which both resemble each other most."""
    played = _takes_played(spark, d).select("file", "ver_nbr", "tune", "place", F.col("exact").alias("pitch"))
    return rounded(sequences.tuning_shifts(played, _written(spark, d), ["file", "ver_nbr"]), 6, "ratio")


@registry.query("greedy_match")
def greedy_match(spark: SparkSession, d: str) -> DataFrame:
    """Starts of takes and of notes matched one to one, within half a second."""
    k = views.takes(spark, d).filter(F.col("start").isNotNull()).select("file", F.col("start").alias("t")).distinct()
    n = views.notes(spark, d).select("file", F.col("start").alias("t")).distinct()
    return sequences.greedy_match(k, n, ["file"], 0.5)


@registry.query("note_segmentation")
def note_segmentation(spark: SparkSession, d: str) -> DataFrame:
    """Notes found in the frequency and amplitude series of each recording."""
    p = views.points(spark, d)
    f0 = p.filter("label = 'barrel_f0'").groupBy("rec_id", "t").agg(F.min("v").alias("f0"))
    ampl = p.filter("label = 'barrel_ampl'").groupBy("rec_id", F.col("t").alias("mark_t")).agg(F.min("v").alias("ampl"))
    both = intervals.lerp(f0, ampl, ["rec_id"], "ampl").filter("ampl IS NOT NULL")
    x = segment.segment_series(both, ["rec_id"])
    return rounded(x, 6, "mean_pitch", "mean_db", "std_db")


_LEVEL = """pt AS (SELECT file, t, 20 * log10(greatest(min(v), 1e-9)) AS db FROM p WHERE label = 'barrel_ampl' GROUP BY file, t),
tp AS (SELECT n.note_key, n.file, n."start", n."end", max_by(t, (db, -t)) AS top_t FROM n JOIN pt ON pt.file = n.file AND t BETWEEN n."start" AND n."end" GROUP BY ALL),
sp AS (SELECT *, least(top_t, greatest(coalesce(lag(top_t) OVER w, -1e300), top_t - 10)) AS a, greatest(top_t, least(coalesce(lead(top_t) OVER w, 1e300), top_t + 10)) AS b FROM tp WINDOW w AS (PARTITION BY file ORDER BY "start", note_key)),
j AS (SELECT sp.*, pt.t, pt.db, lag(pt.db) OVER w AS db1, lead(pt.db) OVER w AS db2, lag(pt.t) OVER w AS t1 FROM sp JOIN pt ON pt.file = sp.file AND pt.t BETWEEN sp.a AND sp.b WINDOW w AS (PARTITION BY note_key ORDER BY pt.t)),
e AS (SELECT note_key, min_by(t, (db - 4 * t, t)) FILTER (t <= top_t) AS attack_start, min_by(t, (db + 4 * t, t)) FILTER (t >= top_t) AS release_end,
  min_by(t, (abs(t - "start"), t)) FILTER (db < db1 AND db < db2 AND t < top_t) AS prev_local_min, min_by(t, (abs(t - "end"), t)) FILTER (db < db1 AND db < db2 AND t > top_t) AS next_local_min FROM j GROUP BY note_key),
c AS (SELECT note_key, max_by(t, (db - 40 * t, -t)) FILTER (t BETWEEN attack_start AND top_t) AS attack_corner, max_by(t, (db + 80 * t, -t)) FILTER (t BETWEEN top_t AND release_end) AS release_corner FROM j JOIN e USING (note_key) GROUP BY note_key)"""


@registry.query(
    "attack_release",
    _sql("""SELECT note_key, top_t, attack_start, attack_corner, release_corner, release_end, prev_local_min, next_local_min, coalesce(next_local_min, release_end) AS next_dip,
  round(max(db) FILTER (t = attack_corner) - max(db) FILTER (t = attack_start), 6) AS attack_db, round(max(s), 4) AS max_slope, round(quantile_cont(s, 0.5), 4) AS median_slope
FROM (SELECT *, CASE WHEN t1 >= attack_start AND t <= attack_corner THEN (db - db1) / nullif(t - t1, 0) END AS s FROM j JOIN e USING (note_key) JOIN c USING (note_key))
GROUP BY note_key, top_t, attack_start, attack_corner, release_corner, release_end, prev_local_min, next_local_min""", P, N, _LEVEL),
)
def attack_release(spark: SparkSession, d: str) -> DataFrame:
    """Corners, dips and slopes of attacks and releases of notes in the barrel's level."""
    p = views.points(spark, d).filter("label = 'barrel_ampl'").groupBy("file", "t").agg(F.min("v").alias("v"))
    return rounded(rounded(segment.attacks(p, views.notes(spark, d), ["file"]), 6, "attack_db"), 4, "max_slope", "median_slope")


@registry.query("segment_and_align")
def segment_and_align(spark: SparkSession, d: str) -> DataFrame:
    """Notes found in each recording, aligned with the score of its tune: rec_id, note_nbr, start, end, score_place, repetition; only those that are matched."""
    found = checkpointed(note_segmentation(spark, d).select("rec_id", "note_nbr", "start", "end", "round_pitch"))
    rec = table(spark, d, "recordings").select("rec_id", F.nullif(F.trim("tune"), F.lit("")).alias("tune"))
    played = found.join(broadcast_if_small(rec), "rec_id").select("rec_id", "tune", F.col("note_nbr").alias("place"), (F.rint(F.col("round_pitch") + 2) + 69).cast("long").alias("pitch"))
    aligned = sequences.align_takes(played, _written(spark, d), ["rec_id"]).filter("score_place IS NOT NULL AND played_place IS NOT NULL")
    return aligned.withColumnRenamed("played_place", "note_nbr").join(found.select("rec_id", "note_nbr", "start", "end"), ["rec_id", "note_nbr"])


# Synchronisation

_PEAKS = """pk AS (
  SELECT h.rec_id, s.label, s.series_id, CAST(floor(s.t / 0.05) AS BIGINT) AS bin, CAST(floor(4 * log2(greatest(s.v, 0.001))) AS BIGINT) AS level
  FROM (SELECT *, max(v) OVER (w ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING) AS a, max(v) OVER (w ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING) AS b FROM r WHERE r.label LIKE '%ampl' WINDOW w AS (PARTITION BY series_id ORDER BY frame_idx)) s
  JOIN h USING (series_id) WHERE s.v > s.a AND s.v > s.b GROUP BY ALL
)"""


def _peaks(spark: SparkSession, d: str) -> DataFrame:
    """Peaks of amplitude series: rec_id, label, series_id, bin of 50 ms, level in quarter octaves."""
    r = views.readings(spark, d).filter(F.col("label").endswith("_ampl"))
    x = windows.local_maxima(r, ["series_id"], ["frame_idx"], "v", 2)
    level = F.floor(4 * F.log2(F.greatest("v", F.lit(0.001))))
    h = broadcast_if_small(views.headers(spark, d).select("series_id", "rec_id"))
    return x.join(h, "series_id").select("rec_id", "label", "series_id", F.floor(F.col("t") / 0.05).alias("bin"), level.alias("level")).distinct()


_PAIRS = "pp AS (SELECT a.rec_id, a.label, a.series_id, a.bin AS t, b.bin - a.bin AS dt, a.level AS level1, b.level AS level2 FROM pk a JOIN pk b ON a.series_id = b.series_id AND b.bin - a.bin BETWEEN 2 AND 12)"


def _pairs(peaks: DataFrame) -> DataFrame:
    return sync.peak_pairs(peaks, ["rec_id", "label", "series_id"], "bin", 2, 12, ["level"])


@registry.query("peak_pairs", _sql("SELECT series_id, t, dt, level1, level2 FROM pp", R, H, _PEAKS, _PAIRS))
def peak_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of peaks of a series 100 to 600 ms apart: fingerprints."""
    return _pairs(_peaks(spark, d)).select("series_id", "t", "dt", "level1", "level2")


_MATCH = """x AS (SELECT DISTINCT rec_id, t, dt, level2 - level1 AS step FROM pp WHERE label = 'barrel_ampl'),
y AS (SELECT DISTINCT rec_id, t, dt, level2 - level1 AS step FROM pp WHERE label = 'external_ampl'),
o AS (SELECT x.rec_id, y.t - x.t AS delta, count(*) AS c FROM x JOIN y ON x.rec_id = y.rec_id AND x.dt = y.dt AND x.step = y.step GROUP BY ALL),
v AS (SELECT rec_id, delta AS mode FROM o QUALIFY row_number() OVER (PARTITION BY rec_id ORDER BY c DESC, delta) = 1),
q AS (SELECT rec_id, CAST(sum(c) AS BIGINT) AS n_matches FROM o GROUP BY rec_id)"""


@registry.query(
    "fingerprint_offset_vote",
    _sql("SELECT o.rec_id, v.mode, q.n_matches, round(CAST(sum(o.delta * o.c) AS DOUBLE) / sum(o.c), 6) AS delay, round(CAST(sum(o.c) AS DOUBLE) / q.n_matches, 6) AS share FROM o JOIN v USING (rec_id) JOIN q USING (rec_id) WHERE abs(o.delta - v.mode) < 2 GROUP BY o.rec_id, v.mode, q.n_matches", R, H, _PEAKS, _PAIRS, _MATCH),
)
def fingerprint_offset_vote(spark: SparkSession, d: str) -> DataFrame:
    """Offset between the barrel's and the external microphone's series of a recording, by matching fingerprints wherever they lie."""
    # Peaks are few; four readers would find them again.
    peaks = checkpointed(_peaks(spark, d).filter("label IN ('barrel_ampl', 'external_ampl')"))
    f = _pairs(peaks).withColumn("step", F.col("level2") - F.col("level1"))
    x, y = (f.filter(F.col("label") == c).select("rec_id", "dt", "step", "t").distinct() for c in ("barrel_ampl", "external_ampl"))
    return rounded(sync.offset_vote(sync.offset_counts(x, y, ["rec_id"], ["dt", "step"], "t"), ["rec_id"], "delta", count="n"), 6, "delay", "share")


@registry.query(
    "lattice_nn",
    """WITH q AS (SELECT DISTINCT mark_id, """ + path_sql("video_file") + """ AS video, floor((bbox[1] + bbox[3] / 2) / 40)::BIGINT AS gx, floor((bbox[2] + bbox[4] / 2) / 40)::BIGINT AS gy, floor(bbox[3] / 16)::BIGINT AS gw, source FROM video_marks),
a AS (SELECT * FROM q WHERE source = 'template'), b AS (SELECT video, gx, gy, gw, min(mark_id) AS other_id FROM q WHERE source = 'aruco' GROUP BY ALL)
SELECT mark_id, other_id, square FROM (SELECT a.mark_id, b.other_id, (a.gx - b.gx) * (a.gx - b.gx) + (a.gy - b.gy) * (a.gy - b.gy) + (a.gw - b.gw) * (a.gw - b.gw) AS square FROM a JOIN b ON a.video = b.video)
WHERE square <= 4 QUALIFY row_number() OVER (PARTITION BY mark_id ORDER BY square, other_id) = 1""",
)
def lattice_nn(spark: SparkSession, d: str) -> DataFrame:
    """For each template mark the nearest aruco mark of its video on a lattice of place and size."""
    m = views.marks(spark, d)
    dims = [F.floor((F.col("x") + F.col("w") / 2) / 40).alias("gx"), F.floor((F.col("y") + F.col("h") / 2) / 40).alias("gy"), F.floor(F.col("w") / 16).alias("gw")]
    a = m.filter("source = 'template'").select("video", "mark_id", *dims)
    b = m.filter("source = 'aruco'").select("video", F.col("mark_id").alias("other_id"), *dims)
    x = sync.lattice_nearest(a, b, ["video"], ["gx", "gy", "gw"], 2, "mark_id", "other_id")
    return x.select("mark_id", "other_id", F.col("square").cast("long").alias("square"))


@registry.query(
    "xcorr_delay",
    _sql("""SELECT rec_id, lag, n, round(c, 4) AS correlation FROM (SELECT x.rec_id, (y.slot - x.slot)::INT AS lag, sum(CAST(x.v AS DECIMAL(18, 6)) * CAST(y.v AS DECIMAL(18, 6)))::DOUBLE / any_value(least(m.nx, m.ny)) AS c, count(*) AS n FROM x JOIN y ON y.rec_id = x.rec_id JOIN m ON m.rec_id = x.rec_id GROUP BY ALL)
QUALIFY row_number() OVER (PARTITION BY rec_id ORDER BY round(c, 5) DESC, abs(lag), lag) = 1""",
         P, "x AS (SELECT rec_id, floor(t / 0.1)::BIGINT AS slot, max(v) AS v FROM p WHERE label = 'barrel_ampl' GROUP BY ALL)", "y AS (SELECT rec_id, floor(t / 0.1)::BIGINT AS slot, max(v) AS v FROM p WHERE label = 'external_ampl' GROUP BY ALL)",
         "m AS (SELECT rec_id, nx, ny FROM (SELECT rec_id, count(*) AS nx FROM x GROUP BY ALL) JOIN (SELECT rec_id, count(*) AS ny FROM y GROUP BY ALL) USING (rec_id))"),
)
def xcorr_delay(spark: SparkSession, d: str) -> DataFrame:
    """Lag, of all there are, in tenths of a second, at which two series of a recording correlate most."""
    p = views.points(spark, d).withColumn("slot", F.floor(F.col("t") / 0.1))
    x, y = (p.filter(F.col("label") == c).groupBy("rec_id", "slot").agg(F.max("v").alias("v")) for c in ("barrel_ampl", "external_ampl"))
    best = sync.best_lag(sync.lag_correlation(x, y, ["rec_id"]), ["rec_id"])
    return rounded(best, 4, "correlation").select("rec_id", "lag", "n", "correlation")


@registry.query(
    "best_match_per_key",
    f"""SELECT signal, video, frac FROM (SELECT {path_sql('signal_file')} AS signal, {path_sql('video_file')} AS video, frac FROM wav_video_delays WHERE frac > 0.01)
QUALIFY row_number() OVER (PARTITION BY signal ORDER BY frac DESC, video) = 1""",
)
def best_match_per_key(spark: SparkSession, d: str) -> DataFrame:
    """The video that matches each signal file best."""
    x = table(spark, d, "wav_video_delays").filter("frac > 0.01").select(path_key("signal_file").alias("signal"), path_key("video_file").alias("video"), "frac")
    w = windows.ordered(["signal"], F.desc("frac"), "video")
    return x.withColumn("i", F.row_number().over(w)).filter("i = 1").drop("i")


@registry.query(
    "directory_pairs",
    f"""WITH w AS (SELECT DISTINCT regexp_extract(file, '^(.*)/[^/]*$', 1) AS folder, file FROM (SELECT {path_sql('filename')} AS file FROM recordings)),
v AS (SELECT DISTINCT regexp_extract(video, '^(.*)/[^/]*$', 1) AS folder, video FROM (SELECT {path_sql('video_file')} AS video FROM video_marks))
SELECT w.file, v.video, replace(w.file || v.video, '/', '_') AS output FROM w JOIN v USING (folder)""",
)
def directory_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Recordings and videos in the same folder, and the name their comparison would have."""
    folder = lambda c: F.regexp_extract(c, r"^(.*)/[^/]*$", 1).alias("folder")
    w = table(spark, d, "recordings").select(path_key("filename").alias("file")).distinct()
    v = table(spark, d, "video_marks").select(path_key("video_file").alias("video")).distinct()
    j = w.select("*", folder("file")).join(v.select("*", folder("video")), "folder")
    return j.select("file", "video", F.translate(F.concat("file", "video"), "/", "_").alias("output"))


# Video


@registry.query(
    "marker_centres",
    _sql("SELECT video, marker_id, count(*) AS n, CAST(sum(x + w / 2) AS DOUBLE) / count(*) AS cx, CAST(sum(y + h / 2) AS DOUBLE) / count(*) AS cy, min(msec) AS first_msec, max(msec) AS last_msec FROM m WHERE marker_id IS NOT NULL GROUP BY ALL", M),
)
def marker_centres(spark: SparkSession, d: str) -> DataFrame:
    """Mean centre of each marker of each video, and when it was seen."""
    m = views.marks(spark, d).filter("marker_id IS NOT NULL")
    mean = lambda c: F.sum(c) / F.count("*")
    return m.groupBy("video", "marker_id").agg(
        F.count("*").alias("n"), mean(F.col("x") + F.col("w") / 2).alias("cx"), mean(F.col("y") + F.col("h") / 2).alias("cy"), F.min("msec").alias("first_msec"), F.max("msec").alias("last_msec")
    )


@registry.query(
    "marker_geometry",
    _sql("""SELECT mark_id, round(degrees(atan((y - py) / nullif(CAST(x - px AS DOUBLE), 0))), 6) AS angle, round(sqrt((x - px) * (x - px) + (y - py) * (y - py)), 6) AS moved, CAST(CASE WHEN h > w THEN 90 ELSE 0 END AS DOUBLE) AS long_side
FROM (SELECT *, lag(x) OVER (PARTITION BY video, marker_id ORDER BY msec, mark_id) AS px, lag(y) OVER (PARTITION BY video, marker_id ORDER BY msec, mark_id) AS py FROM m WHERE marker_id IS NOT NULL) WHERE px IS NOT NULL""", M),
)
def marker_geometry(spark: SparkSession, d: str) -> DataFrame:
    """How far and in which direction each marker moved since it was last seen."""
    w = windows.ordered(["video", "marker_id"], "msec", "mark_id")
    m = views.marks(spark, d).filter("marker_id IS NOT NULL").select("*", F.lag("x").over(w).alias("px"), F.lag("y").over(w).alias("py")).filter("px IS NOT NULL")
    x = m.select("mark_id", exprs.segment_angle(F.col("x") - F.col("px"), F.col("y") - F.col("py")).alias("angle"), exprs.distance("px", "py", "x", "y").alias("moved"), exprs.long_side_angle("w", "h", F.lit(0.0)).alias("long_side"))
    return rounded(x, 6, "angle", "moved")


@registry.query(
    "hsv_mask",
    _sql("SELECT mark_id, (x % 180 >= 150 OR x % 180 <= 20) AND y % 256 BETWEEN 40 AND 255 AND (w * 4) % 256 BETWEEN 30 AND 255 AS in_range FROM m", M),
)
def hsv_mask(spark: SparkSession, d: str) -> DataFrame:
    """Colour predicate with a hue range that goes around; place and size of marks stand for the colour."""
    m = views.marks(spark, d)
    return m.select("mark_id", exprs.hsv_in_range(F.col("x") % 180, F.col("y") % 256, (F.col("w") * 4) % 256, (150, 40, 30), (20, 255, 255)).alias("in_range"))


@registry.query("kalman_smooth")
def kalman_smooth(spark: SparkSession, d: str) -> DataFrame:
    """Smoothed track of each marker of each video."""
    m = views.marks(spark, d).filter("marker_id IS NOT NULL").select("video", "marker_id", "msec", "mark_id", (F.col("x") + F.col("w") / 2).alias("x"), (F.col("y") + F.col("h") / 2).alias("y"))
    return rounded(video.smooth_marks(m, ["video", "marker_id"], "msec", "mark_id"), 6, "smooth_x", "smooth_y")


@registry.query(
    "cut_to_recording",
    _sql("""SELECT m.mark_id, k.ver_id, round(m.msec / 1000 + b.delay - k."start", 6) AS t FROM m JOIN b ON b.video = m.video JOIN k ON k.file = b.signal AND m.msec / 1000 + b.delay > k."start" AND m.msec / 1000 + b.delay < k."end" """, M, K, B),
)
def cut_to_recording(spark: SparkSession, d: str) -> DataFrame:
    """Video marks within each take, on a clock that starts with the take; delays are read however they are typed."""
    delays = sync.best_delays(table(spark, d, "wav_video_delays")).withColumnRenamed("signal", "file")
    m = views.marks(spark, d).join(broadcast_if_small(delays), "video").select("mark_id", "file", (F.col("msec") / 1000 + F.col("delay")).alias("t"))
    j = intervals.interval_join(m, views.takes(spark, d).select("file", "start", "end", "ver_id"), ["file"], closed="neither")
    return rounded(j.select("mark_id", "ver_id", (F.col("t") - F.col("start")).alias("t")), 6, "t")


@registry.query("cut_to_recording_any_delay", registry.sql["cut_to_recording"])
def cut_to_recording_any_delay(spark: SparkSession, d: str) -> DataFrame:
    """The same, by its earlier name."""
    return cut_to_recording(spark, d)


@registry.query(
    "regions_of_marks",
    _sql("""SELECT video, region, min(msec) AS first_msec, max(msec) AS last_msec, count(*) AS n FROM (
  SELECT video, msec, CAST(sum(CASE WHEN msec - b > 2000 OR b IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY video ORDER BY msec, mark_id) AS BIGINT) AS region FROM (SELECT *, lag(msec) OVER (PARTITION BY video ORDER BY msec, mark_id) AS b FROM m)) GROUP BY ALL""", M),
)
def regions_of_marks(spark: SparkSession, d: str) -> DataFrame:
    """Stretches of each video without a pause of more than two seconds between marks."""
    w = windows.ordered(["video"], "msec", "mark_id")
    m = views.marks(spark, d)
    new = F.when((F.col("msec") - F.lag("msec").over(w) > 2000) | F.lag("msec").over(w).isNull(), 1).otherwise(0)
    x = m.withColumn("new", new).withColumn("region", F.sum("new").over(w.rowsBetween(windows.Window.unboundedPreceding, 0)))
    return x.groupBy("video", "region").agg(F.min("msec").alias("first_msec"), F.max("msec").alias("last_msec"), F.count("*").alias("n"))


@registry.query("props_explode", "SELECT event_id, 'k' AS key, CAST(json_extract(props, '$.k') AS BIGINT) AS value FROM events WHERE json_extract(props, '$.k') IS NOT NULL")
def props_explode(spark: SparkSession, d: str) -> DataFrame:
    """Entries of a ragged map, one row each."""
    e = table(spark, d, "events").select("event_id", F.explode(F.from_json("props", "map<string,bigint>")))
    return e.select("event_id", "key", "value").filter("value IS NOT NULL")


# Signals


_DFT = f"(SELECT g.series_id, g.frame, k.k, sqrt(pow(sum(g.v * cos(2 * pi() * k.k * g.place / {_WINDOW})), 2) + pow(sum(g.v * sin(2 * pi() * k.k * g.place / {_WINDOW})), 2)) AS a FROM g CROSS JOIN (SELECT unnest(range({_WINDOW // 2 + 1})) AS k) k WHERE held = {_WINDOW} GROUP BY ALL)"


@registry.query("stft_centroid", "WITH " + R.replace("FROM readings\n  WHERE", "FROM readings\n  WHERE label = 'barrel_ampl' AND") + ", " + _FRAMED + f" SELECT series_id, frame, round(sum(a * k) / sum(a), 5) AS centroid FROM {_DFT} GROUP BY ALL HAVING sum(a) > 0")
def stft_centroid(spark: SparkSession, d: str) -> DataFrame:
    """Centre of the spectrum of each frame of the barrel's amplitude."""
    f = _framed(views.readings(spark, d).filter("label = 'barrel_ampl'"))
    g = f.groupBy("series_id", "frame").agg(F.sort_array(F.collect_list(F.struct("place", "v"))).alias("s")).withColumn("samples", F.col("s.v"))
    return rounded(g.select("series_id", "frame", signals.frame_centroid("samples").alias("centroid")).filter("centroid IS NOT NULL"), 5, "centroid")


@registry.query("yin_f0")
def yin_f0(spark: SparkSession, d: str) -> DataFrame:
    """How often a second the coverage and the angle of the instrument swing, for each block of 128 readings."""
    r = views.readings(spark, d).filter("label IN ('cl_angle', 'reed_dc')").withColumn("block", F.floor(F.col("frame_idx") / 128))
    g = r.groupBy("series_id", "block").agg(F.sort_array(F.collect_list(F.struct("frame_idx", "v"))).alias("s"), F.count("*").alias("n"), (F.max("t") - F.min("t")).alias("span"))
    g = g.filter("n >= 64 AND span > 0").withColumn("samples", F.col("s.v"))
    x = g.select("series_id", "block", signals.frame_yin("samples", (F.col("n") - 1) / F.col("span"), 0.5, 20.0).alias("hz"))
    return rounded(x, 6, "hz")


@registry.query(
    "heterodyne",
    _sql("SELECT series_id, CAST(floor(t) AS BIGINT) AS second, " + ", ".join(f"round(2 * avg(v * cos(2 * pi() * {k} * t)), 5) AS re_{k}, round(-2 * avg(v * sin(2 * pi() * {k} * t)), 5) AS im_{k}" for k in (1, 2, 3)) + " FROM r WHERE r.label = 'reed_dc' GROUP BY ALL", R),
)
def heterodyne(spark: SparkSession, d: str) -> DataFrame:
    """Complex amplitude of the first three hertz of the reed's displacement, for each second."""
    r = views.readings(spark, d).filter("label = 'reed_dc'").withColumn("second", F.floor("t"))
    x = signals.heterodyne(r, ["series_id", "second"], "t", "v", [1.0, 2.0, 3.0])
    return rounded(x, 5, *[c for c in x.columns if c[:3] in ("re_", "im_")])


@registry.query(
    "complex_ratio",
    _sql("""SELECT a.rec_id, a.second, round((a.re * b.re + a.im * b.im) / (b.re * b.re + b.im * b.im), 4) AS re, round((a.im * b.re - a.re * b.im) / (b.re * b.re + b.im * b.im), 4) AS im
FROM c a JOIN c b ON a.rec_id = b.rec_id AND a.second = b.second AND a.label = 'barrel_ampl' AND b.label = 'external_ampl' WHERE b.re * b.re + b.im * b.im > 0.01""",
         P, "c AS (SELECT rec_id, label, CAST(floor(t) AS BIGINT) AS second, 2 * avg(v * cos(2 * pi() * t)) AS re, -2 * avg(v * sin(2 * pi() * t)) AS im FROM p WHERE label IN ('barrel_ampl', 'external_ampl') GROUP BY ALL)"),
)
def complex_ratio(spark: SparkSession, d: str) -> DataFrame:
    """Transfer between two channels at one hertz, for each second."""
    p = views.points(spark, d).filter("label IN ('barrel_ampl', 'external_ampl')").withColumn("second", F.floor("t"))
    c = signals.heterodyne(p, ["rec_id", "second", "label"], "t", "v", [1.0])
    a = c.filter("label = 'barrel_ampl'").select("rec_id", "second", F.col("re_1").alias("ar"), F.col("im_1").alias("ai"))
    b = c.filter("label = 'external_ampl'").select("rec_id", "second", F.col("re_1").alias("br"), F.col("im_1").alias("bi"))
    size = F.col("br") * F.col("br") + F.col("bi") * F.col("bi")
    j = a.join(b, ["rec_id", "second"]).filter(size > 0.01)
    re, im = (F.col("ar") * F.col("br") + F.col("ai") * F.col("bi")) / size, (F.col("ai") * F.col("br") - F.col("ar") * F.col("bi")) / size
    return rounded(j.select("rec_id", "second", re.alias("re"), im.alias("im")), 4, "re", "im")


@registry.query(
    "detune_of_takes",
    _sql(f"SELECT n.file, n.ver_nbr, round(atan2(avg(sin(2 * pi() * 12 * log2(n.f0 / 440))), avg(cos(2 * pi() * 12 * log2(n.f0 / 440)))) / (2 * pi()), 6) AS detune, count(*) AS n FROM n JOIN score s ON s.tune = n.tune AND s.note_id = n.note_id WHERE n.f0 IS NOT NULL GROUP BY ALL", N, _SCORE),
)
def detune_of_takes(spark: SparkSession, d: str) -> DataFrame:
    """How far each take is off equal temperament, as a circular mean in semitones."""
    n = views.notes(spark, d).filter("f0 IS NOT NULL").join(broadcast_if_small(_score(spark, d)), ["tune", "note_id"])
    x = n.groupBy("file", "ver_nbr").agg((exprs.circular_mean(exprs.semitones("f0") * (2 * math.pi)) / (2 * math.pi)).alias("detune"), F.count("*").alias("n"))
    return rounded(x, 6, "detune")


@registry.query(
    "subject_percentiles",
    _sql("SELECT subject_id, " + ", ".join(f"round(quantile_cont(f0, {p}), 8) AS p{round(100 * p):02d}" for p in (0.05, 0.5, 0.95)) + " FROM n WHERE f0 IS NOT NULL GROUP BY ALL", N),
)
def subject_percentiles(spark: SparkSession, d: str) -> DataFrame:
    x = stats.percentiles(views.notes(spark, d).filter("f0 IS NOT NULL"), ["subject_id"], "f0", (0.05, 0.5, 0.95))
    return rounded(x, 8, "p05", "p50", "p95")


@registry.query(
    "robust_lines",
    _sql("""SELECT a.video, a.marker_id, round(coalesce(s.slope, 0), 6) AS slope, round(quantile_cont(a.w - coalesce(s.slope, 0) * a.msec, 0.5), 6) AS intercept, count(*) AS n FROM m a
LEFT JOIN (SELECT x.video, x.marker_id, quantile_cont((y.w - x.w) / (y.msec - x.msec), 0.5) AS slope FROM m x JOIN m y ON x.video = y.video AND x.marker_id = y.marker_id AND x.mark_id < y.mark_id AND x.msec <> y.msec GROUP BY ALL) s
  ON s.video = a.video AND s.marker_id = a.marker_id
WHERE a.marker_id IS NOT NULL GROUP BY a.video, a.marker_id, s.slope""", M),
)
def robust_lines(spark: SparkSession, d: str) -> DataFrame:
    """Width of each marker over the time of its video as a line that half of its detections agree with."""
    m = views.marks(spark, d).filter("marker_id IS NOT NULL").select("video", "marker_id", "msec", F.col("w").cast("double").alias("w"))
    return rounded(video.robust_lines(m, ["video", "marker_id"], "msec", "w"), 6, "slope", "intercept")


@registry.query(
    "marker_counts",
    _sql("SELECT video, count(*) AS n, count(DISTINCT marker_id) AS n_markers, count(*) FILTER (marker_id IS NULL) AS n_unknown, count(*) FILTER (source = 'template') AS n_template, round(CAST(sum(CAST(template_val AS DECIMAL(28, 6))) AS DOUBLE) / count(template_val), 8) AS mean_template FROM m GROUP BY video", M),
)
def marker_counts(spark: SparkSession, d: str) -> DataFrame:
    """What was detected in each video."""
    m = views.marks(spark, d)
    x = m.groupBy("video").agg(
        F.count("*").alias("n"), F.countDistinct("marker_id").alias("n_markers"), F.count_if(F.col("marker_id").isNull()).alias("n_unknown"), F.count_if(F.col("source") == "template").alias("n_template"), exprs.exact_avg("template_val").alias("mean_template")
    )
    return rounded(x, 8, "mean_template")


@registry.query(
    "session_regions_stream",
    f"""WITH x AS (SELECT {path_sql('video_file')} AS video, msec FROM video_marks WHERE msec IS NOT NULL),
y AS (SELECT *, CASE WHEN msec - lag(msec) OVER (PARTITION BY video ORDER BY msec) < 2000 THEN 0 ELSE 1 END AS new FROM x),
z AS (SELECT *, sum(new) OVER (PARTITION BY video ORDER BY msec) AS region FROM y)
SELECT video, round(min(msec), 2) AS first_msec, round(max(msec) + 2000, 2) AS end_msec, count(*) AS n FROM z GROUP BY video, region""",
)
def session_regions_stream(spark: SparkSession, d: str) -> DataFrame:
    """Stretches of detections of each video, as a stream of the table's files with session windows of two seconds."""
    path = f"{d}/video_marks.parquet"
    # A pattern, as a stream's source: the table may be a file or a folder of files.
    source = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{d}/video_marks.parque[t]")
    x = source.filter(F.col("msec").isNotNull()).select(path_key("video_file").alias("video"), F.timestamp_micros(F.rint(F.col("msec") * 1000).cast("long")).alias("ts"))
    regions = drained(session_regions(x, "ts", "video", "2 seconds"), shared_folder(spark, "regions"), "complete")
    msec = lambda c: F.round(F.unix_micros(c) / 1000, 2)
    return regions.select("video", msec("start").alias("first_msec"), msec("end").alias("end_msec"), "n")
