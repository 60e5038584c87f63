"""Queries on derived measures of notes, takes, marks and series, and on spectra."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ostinato.functions import exprs
from ostinato.operators import audio, derive, intervals, sequences, signals, stats, sync, video, windows
from ostinato.plans import views
from ostinato.plans.files import audio_files
from ostinato.plans.notes import _SCORE, _THIRD, _score
from ostinato.plans.registry import Registry
from ostinato.plans.series import _FRAMED, _WINDOW, _framed, _normalised
from ostinato.plans.views import K, M, N, P, R, path_sql, rounded, settled, settled_sql
from ostinato.session import broadcast_if_small, path_key, present, table
from ostinato.sources import wav

registry = Registry()


def _sql(text: str, *ctes: str) -> str:
    return "WITH " + ", ".join(ctes) + "\n" + text


# Scalar measures


@registry.query(
    "level_measures",
    _sql("""SELECT note_key, round(20 * log10(greatest(ampl, 1e-12)), 6) AS db, round(20 * log10(f0 / (100 * ampl)), 6) AS ratio, round(20 * log10(f0_var / (100 * ampl) + 100 * ampl_var * f0 / (100 * ampl * (100 * ampl))), 6) AS ratio_spread,
  CAST(pow(2, ceil(log2(f0))) AS BIGINT) AS next_power, CAST(pow(2, round_even(log2(f0), 0)) AS BIGINT) AS near_power, round(12 * log2(1 + f0_var / f0), 6) AS pitch_trend, greatest(100, least(400, f0)) AS held, round(sqrt(f0 * f0 + ampl * ampl), 6) AS size
FROM n WHERE f0 > 0 AND ampl > 0 AND f0_var > 0 AND ampl_var > 0""", N),
)
def level_measures(spark: SparkSession, d: str) -> DataFrame:
    """Levels, ratios of levels with their variation, powers of two, pitch variation in semitones, values held within bounds."""
    n = views.notes(spark, d).filter("f0 > 0 AND ampl > 0 AND f0_var > 0 AND ampl_var > 0")
    b, b_var = 100 * F.col("ampl"), 100 * F.col("ampl_var")
    x = n.select(
        "note_key", exprs.amplitude_db("ampl").alias("db"), exprs.ratio_db("f0", b).alias("ratio"), exprs.ratio_db_spread("f0", "f0_var", b, b_var).alias("ratio_spread"), exprs.next_power_of_two("f0").alias("next_power"),
        exprs.nearest_power_of_two("f0").alias("near_power"), (12 * F.log2(1 + F.col("f0_var") / F.col("f0"))).alias("pitch_trend"), exprs.clipped("f0", 100.0, 400.0).alias("held"), exprs.total_angle("f0", "ampl").alias("size"),
    )
    return rounded(x, 6, "db", "ratio", "ratio_spread", "pitch_trend", "size")


@registry.query(
    "geometry_measures",
    _sql("""SELECT mark_id, round((300.0 * (y - 100) - 400.0 * (x - 100)) / 500, 6) AS beside, round((300.0 * (x - 100) + 400.0 * (y - 100)) / 500, 6) AS along, round(x * cos(radians(30)) - y * sin(radians(30)), 6) AS turned_x, round(x * sin(radians(30)) + y * cos(radians(30)), 6) AS turned_y,
  round(CASE WHEN least(w, h) <= 2 * sin(radians(20)) * cos(radians(20)) * greatest(w, h) THEN CASE WHEN w >= h THEN 0.5 * h / sin(radians(20)) ELSE 0.5 * w / cos(radians(20)) END ELSE (w * cos(radians(20)) - h * sin(radians(20))) / (pow(cos(radians(20)), 2) - pow(sin(radians(20)), 2)) END, 6) AS inner_w,
  printf('%d(%d) - %s', w, h, source) AS label FROM m""", M),
)
def geometry_measures(spark: SparkSession, d: str) -> DataFrame:
    """Distance of each mark from a line and along it, its place in a turned frame, the upright rectangle in its turned one, a label."""
    m = views.marks(spark, d)
    line = [F.lit(v) for v in (100.0, 100.0, 400.0, 500.0)]
    turned = exprs.rotate("x", "y", F.lit(30.0))
    x = m.select(
        "mark_id", exprs.point_line("x", "y", *line).alias("beside"), exprs.along_line("x", "y", *line).alias("along"), turned[0].alias("turned_x"), turned[1].alias("turned_y"),
        exprs.inner_rectangle("w", "h", F.lit(20.0))[0].alias("inner_w"), exprs.note_label("w", "h", "source").alias("label"),
    )
    return rounded(x, 6, "beside", "along", "turned_x", "turned_y", "inner_w")


@registry.query(
    "mapped_values",
    "SELECT note_key, CASE WHEN lower(trim(i)) = 'lab' THEN 'laboratory' ELSE lower(trim(i)) END AS instrument, f0_avg, f0_var FROM (SELECT DISTINCT note_key, instrument AS i, f0_avg, f0_var FROM notes)",
)
def mapped_values(spark: SparkSession, d: str) -> DataFrame:
    """Instruments by a list of replacements, and columns without the prefix of their channel."""
    n = table(spark, d, "notes").select("note_key", "instrument", F.col("f0_avg").alias("barrel_f0_avg"), F.col("f0_var").alias("barrel_f0_var")).distinct()
    return exprs.without_prefix(n.withColumn("instrument", exprs.remapped("instrument", {"lab": "laboratory"})), "barrel_")


@registry.query(
    "note_errors",
    _sql("""SELECT n.note_key, CASE WHEN num IS NULL THEN 1 ELSE 0 END + CASE WHEN num <> n.note_id THEN 2 ELSE 0 END + CASE WHEN s.pitch IS NULL THEN 4 ELSE 0 END + CASE WHEN k.ver_id IS NULL THEN 8 ELSE 0 END
  + CASE WHEN n.f0 IS NULL THEN 16 ELSE 0 END + CASE WHEN n.ampl IS NULL THEN 32 ELSE 0 END + CASE WHEN n.f0_var IS NULL OR n.ampl_var IS NULL THEN 64 ELSE 0 END AS err
FROM (SELECT *, try_cast(nullif(regexp_extract(note_label, '^\\s*(\\d+)', 1), '') AS INT) AS num FROM n) n LEFT JOIN score s ON s.tune = n.tune AND s.note_id = n.note_id
LEFT JOIN (SELECT file, ver_nbr, min(ver_id) AS ver_id FROM k GROUP BY ALL) k ON k.file = n.file AND k.ver_nbr = n.ver_nbr""", N, K, _SCORE),
)
def note_errors(spark: SparkSession, d: str) -> DataFrame:
    """What each note lacks as bits: 1 no number, 2 another number than its own, 4 no score, 8 no take, 16 frequency, 32 amplitude, 64 their variation."""
    s = _score(spark, d)
    k = views.takes(spark, d).groupBy("file", "ver_nbr").agg(F.min("ver_id").alias("ver_id"))
    x = views.notes(spark, d).join(broadcast_if_small(s), ["tune", "note_id"], "left").join(k, ["file", "ver_nbr"], "left")
    num = exprs.leading_number("note_label")
    bits = {1: num.isNull(), 2: num != F.col("note_id"), 4: F.col("pitch").isNull(), 8: F.col("ver_id").isNull(), 16: F.col("f0").isNull(), 32: F.col("ampl").isNull(), 64: F.col("f0_var").isNull() | F.col("ampl_var").isNull()}
    return x.select("note_key", derive.error_bits(bits).alias("err"))


# Takes and scores


@registry.query(
    "take_against_score",
    _sql("SELECT coalesce(a.file, b.file) AS file, coalesce(a.ver_nbr, b.ver_nbr) AS ver_nbr, coalesce(a.note_id, b.note_id) AS note_id, a.n_played, b.pitch FROM (SELECT file, ver_nbr, note_id, count(*) AS n_played FROM n WHERE note_id IS NOT NULL GROUP BY ALL) a FULL JOIN (SELECT k.file, k.ver_nbr, s.note_id, min(s.pitch) AS pitch FROM k JOIN score s ON s.tune = k.tune GROUP BY ALL) b ON a.file = b.file AND a.ver_nbr = b.ver_nbr AND a.note_id = b.note_id", N, K, _SCORE),
)
def take_against_score(spark: SparkSession, d: str) -> DataFrame:
    """What each take plays and what its score asks for, note by note; null where one of them lacks the note."""
    a = views.notes(spark, d).filter("note_id IS NOT NULL").groupBy("file", "ver_nbr", "note_id").agg(F.count("*").alias("n_played"))
    b = views.takes(spark, d).join(broadcast_if_small(_score(spark, d)), "tune").groupBy("file", "ver_nbr", "note_id").agg(F.min("pitch").alias("pitch"))
    return a.join(b, ["file", "ver_nbr", "note_id"], "full")


@registry.query(
    "label_tune",
    f"""WITH t AS (SELECT replace(tune, '_', '') AS name, min(rec_id) AS place FROM recordings WHERE trim(tune) <> '' GROUP BY ALL)
SELECT ver_id, name AS tune FROM (SELECT v.ver_id, t.name, row_number() OVER (PARTITION BY v.ver_id ORDER BY t.place, t.name) AS i FROM versions v JOIN t ON contains({path_sql('v.wavfile')}, t.name)) WHERE i = 1""",
)
def label_tune(spark: SparkSession, d: str) -> DataFrame:
    """The first tune of the list whose name the path of a take holds anywhere."""
    t = table(spark, d, "recordings").filter(F.trim("tune") != "").select(F.translate("tune", "_", "").alias("tune"), F.col("rec_id").alias("place"))
    v = table(spark, d, "versions").select("ver_id", path_key("wavfile").alias("file"))
    return sync.contained_names(v, t, "file", "tune", "place").select("ver_id", "tune")


@registry.query(
    "files_of_stem",
    f"""WITH f AS (SELECT DISTINCT {path_sql('wavfile')} AS file FROM notes), w AS (SELECT DISTINCT {path_sql('video_file')} AS video FROM video_marks)
SELECT w.video, min(f.file) AS file FROM w JOIN f ON contains(w.video, '/' || regexp_extract(f.file, '([^/]*)[.][^./]*$', 1) || '_') GROUP BY w.video""",
)
def files_of_stem(spark: SparkSession, d: str) -> DataFrame:
    """Videos whose path holds the name of a file with notes."""
    f = table(spark, d, "notes").select(path_key("wavfile").alias("file")).distinct().select("file", F.concat(F.lit("/"), F.regexp_extract("file", r"([^/]*)[.][^./]*$", 1), F.lit("_")).alias("stem"))
    w = table(spark, d, "video_marks").select(path_key("video_file").alias("video")).distinct()
    return sync.contained_names(w, f, "video", "stem", "file").join(f, "stem").groupBy("video").agg(F.min("file").alias("file"))


@registry.query(
    "anti_takes_of_tune",
    _sql("SELECT k.ver_id FROM k WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.file = k.file AND n.ver_nbr = k.ver_nbr AND n.f0 > 700)", N, K),
)
def anti_takes_of_tune(spark: SparkSession, d: str) -> DataFrame:
    """Takes without any high note."""
    return views.takes(spark, d).join(views.notes(spark, d).filter("f0 > 700").select("file", "ver_nbr"), ["file", "ver_nbr"], "left_anti").select("ver_id")


_LINES = """l AS (SELECT l_orderkey, l_shipdate, l_linenumber, l_partkey, l_quantity AS beats, l_extendedprice AS seconds, l_returnflag <> 'R' AS strict, l_returnflag = 'A' AS strong,
  sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_partkey ROWS UNBOUNDED PRECEDING) - l_quantity AS b0 FROM lineitem)"""
_LINE = ["l_shipdate", "l_linenumber", "l_partkey"]


def _lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines of an order as the notes of a take: quantity in beats, price in seconds."""
    return table(spark, d, "lineitem").select("l_orderkey", *_LINE, F.col("l_quantity").alias("beats"), F.col("l_extendedprice").alias("seconds"), (F.col("l_returnflag") != "R").alias("strict"), (F.col("l_returnflag") == "A").alias("strong"))


@registry.query(
    "local_tempo_beats",
    _sql("""SELECT a.l_orderkey, a.l_shipdate, a.l_linenumber, a.l_partkey, round(60 * sum(b.beats) / nullif(CAST(sum(CAST(b.seconds AS DECIMAL(28, 6))) AS DOUBLE), 0), 6) AS tempo, round(60 * a.beats / nullif(a.seconds, 0), 6) AS own_tempo, """ + settled_sql("60 * a.beats / nullif(60 * sum(b.beats) / nullif(CAST(sum(CAST(b.seconds AS DECIMAL(28, 6))) AS DOUBLE), 0), 0)", 3) + """ AS expected
FROM l a JOIN l b ON a.l_orderkey = b.l_orderkey AND b.strict AND b.b0 + b.beats > a.b0 - 40 AND b.b0 < a.b0 + 40 WHERE a.strict GROUP BY a.l_orderkey, a.l_shipdate, a.l_linenumber, a.l_partkey, a.beats, a.seconds""", _LINES),
)
def local_tempo_beats(spark: SparkSession, d: str) -> DataFrame:
    """Tempo around each strict note, of the strict notes within a bar of beats, and how long the note would last at it."""
    return settled(rounded(derive.beats_around(_lines(spark, d), ["l_orderkey"], _LINE, 40.0), 6, "tempo", "own_tempo"), 3, "expected")


@registry.query(
    "beats_since_strong",
    _sql("SELECT l_orderkey, l_shipdate, l_linenumber, l_partkey, coalesce(sum(beats) OVER (PARTITION BY l_orderkey, bar ORDER BY l_shipdate, l_linenumber, l_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS beat_in_bar FROM (SELECT *, sum(strong::INT) OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_partkey ROWS UNBOUNDED PRECEDING) AS bar FROM l)", _LINES),
)
def beats_since_strong(spark: SparkSession, d: str) -> DataFrame:
    """Beats before each note since the last strong one."""
    return derive.bar_positions_reset(_lines(spark, d), ["l_orderkey"], _LINE).select("l_orderkey", *_LINE, "beat_in_bar")


@registry.query(
    "onset_disparity",
    _sql("""SELECT note_key, round(ioi - avg(ioi) OVER (PARTITION BY tune, note_id), 6) AS disparity, round((sound_start - "start") / nullif("end" - "start", 0), 6) AS rel_start FROM (
  SELECT *, coalesce(lead("start") OVER (PARTITION BY file, ver_nbr ORDER BY "start", note_key) - "start", "end" - "start") AS ioi FROM n)""", N),
)
def onset_disparity(spark: SparkSession, d: str) -> DataFrame:
    """How much longer than usual for its place in the tune each note takes to the next, and where its sound sets in, as a share of it."""
    x = derive.inter_onset(views.notes(spark, d), ["file", "ver_nbr"], ["start", "note_key"])
    usual = F.avg("ioi").over(windows.Window.partitionBy("tune", "note_id"))
    rel = (F.col("sound_start") - F.col("start")) / F.nullif(F.col("end") - F.col("start"), F.lit(0.0))
    return rounded(x.select("note_key", (F.col("ioi") - usual).alias("disparity"), rel.alias("rel_start")), 6, "disparity", "rel_start")


# Series


for _mode, _middle, _spread in (("p5_p95", "quantile_cont(v, 0.05)", "quantile_cont(v, 0.95) - quantile_cont(v, 0.05)"), ("peak", "0.0", "max(abs(v))")):
    _normalised(_mode, _middle, _spread, registry)


@registry.query(
    "complex_extremes",
    _sql("""SELECT note_key, round(max(a), 6) AS abs_max_v, min(t) FILTER (a = hi) AS abs_max_t, round(min(a), 6) AS abs_min_v, min(t) FILTER (a = lo) AS abs_min_t, round(max(dev + c), 5) AS arg_max_v, round(min(dev + c), 5) AS arg_min_v,
  """ + ", ".join(f"round(quantile_cont(a, 0.5) FILTER (third = {i}), 6) AS abs_t{i}, round(quantile_cont(dev, 0.5) FILTER (third = {i}), 5) AS arg_t{i}" for i in (1, 2, 3)) + """
FROM (SELECT *, (((ang - c + pi()) % (2 * pi())) + 2 * pi()) % (2 * pi()) - pi() AS dev, max(a) OVER (PARTITION BY note_key) AS hi, min(a) OVER (PARTITION BY note_key) AS lo FROM (
  SELECT j.*, round(sqrt(re * re + im * im), 6) AS a, CASE WHEN re <> 0 OR im <> 0 THEN atan2(im, re) END AS ang, cc.c FROM j JOIN (SELECT note_key, atan2(quantile_cont(im, 0.5), quantile_cont(re, 0.5)) AS c FROM j GROUP BY note_key) cc USING (note_key))) GROUP BY note_key""",
         P, N, f"j AS (SELECT x.note_key, p.t, {_THIRD} AS third, p.v * cos(2 * pi() * p.t) AS re, p.v * sin(2 * pi() * p.t) AS im FROM n x JOIN p ON p.file = x.file AND p.t BETWEEN x.\"start\" AND x.\"end\" WHERE p.label = 'barrel_ampl')"),
)
def complex_extremes(spark: SparkSession, d: str) -> DataFrame:
    """Extremes and thirds of modulus and angle of a complex series within notes."""
    p = views.points(spark, d).filter("label = 'barrel_ampl'")
    turn = 2 * math.pi * F.col("t")
    p = p.select("file", "t", (F.col("v") * F.cos(turn)).alias("re"), (F.col("v") * F.sin(turn)).alias("im"))
    j = intervals.interval_join(p, views.notes(spark, d).select("note_key", "file", "start", "end"), ["file"])
    x = stats.angle_extremes(j, ["note_key"])
    return rounded(rounded(x, 6, "abs_max_v", "abs_min_v", "abs_t1", "abs_t2", "abs_t3"), 5, "arg_max_v", "arg_min_v", "arg_t1", "arg_t2", "arg_t3")


@registry.query(
    "phrase_silences",
    _sql("""SELECT series_id, s AS "start", e AS "end" FROM (SELECT series_id, coalesce(b, first) AS s, coalesce(a, last) AS e FROM (
  SELECT series_id, first, last, "end" AS b, lead("start") OVER (PARTITION BY series_id ORDER BY k) AS a FROM (
    SELECT series_id, NULL AS "start", NULL AS "end", first, last, -1e300 AS k FROM s UNION ALL
    SELECT o.series_id, o.t, coalesce(o.nxt, s.last), s.first, s.last, o.t FROM (SELECT *, lead(t) OVER (PARTITION BY series_id ORDER BY t) AS nxt FROM (
      SELECT series_id, t, CASE WHEN is_on AND NOT was THEN 'on' WHEN NOT is_on AND was THEN 'off' END AS edge FROM (
        SELECT *, coalesce(lag(is_on) OVER (PARTITION BY series_id ORDER BY t), FALSE) AS was FROM (SELECT q.*, q.v >= threshold AS is_on FROM q JOIN s USING (series_id)))) WHERE edge IS NOT NULL) o JOIN s USING (series_id) WHERE edge = 'on'))) WHERE s < e""",
         R, "q AS (SELECT series_id, t, max(v) AS v FROM r WHERE r.label = 'mouth_dc' GROUP BY ALL)", "s AS (SELECT series_id, quantile_cont(v, 0.99) * 0.2 AS threshold, min(t) AS first, max(t) AS last FROM q GROUP BY series_id)"),
)
def phrase_silences(spark: SparkSession, d: str) -> DataFrame:
    """The silences between the phrases of each series."""
    r = views.readings(spark, d).filter("label = 'mouth_dc'").groupBy("series_id", "t").agg(F.max("v").alias("v"))
    return windows.silences(r, ["series_id"], "t", "v", 0.2)


@registry.query(
    "clip_segments",
    _sql("""SELECT series_id, w, direction FROM (SELECT *, CASE WHEN coalesce(b, 0) < thr AND rms >= thr THEN 'up' WHEN b >= thr AND rms < thr THEN 'down' END AS direction FROM (
  SELECT *, lag(rms) OVER (PARTITION BY series_id ORDER BY w) AS b, quantile_cont(rms, 0.9) OVER (PARTITION BY series_id) * 0.6 AS thr FROM (
    SELECT series_id, CAST(floor(t / 2) AS BIGINT) AS w, round(sqrt(avg(v * v)), 8) AS rms FROM r WHERE r.label = 'barrel_ampl' GROUP BY ALL))) WHERE direction IS NOT NULL""", R),
)
def clip_segments(spark: SparkSession, d: str) -> DataFrame:
    """Where the level of frames of two seconds rises above a share of its 90th percentile and falls below it."""
    f = views.readings(spark, d).filter("label = 'barrel_ampl'").groupBy("series_id", F.floor(F.col("t") / 2).alias("w")).agg(F.round(F.sqrt(F.avg(F.col("v") * F.col("v"))), 8).alias("rms"))
    thr = f.groupBy("series_id").agg((F.percentile("rms", 0.9) * 0.6).alias("thr"))
    x = windows.before(f.join(thr, "series_id"), ["series_id"], ["w"], "rms", "b")
    up, down = (F.coalesce("b", F.lit(0.0)) < F.col("thr")) & (F.col("rms") >= F.col("thr")), (F.col("b") >= F.col("thr")) & (F.col("rms") < F.col("thr"))
    return x.withColumn("direction", F.when(up, "up").when(down, "down")).filter("direction IS NOT NULL").select("series_id", "w", "direction")


@registry.query(
    "loud_reference_pitch",
    _sql("""SELECT rec_id, round(atan2(avg(sin(2 * pi() * 12 * log2(f.v / 440))), avg(cos(2 * pi() * 12 * log2(f.v / 440)))) / (2 * pi()), 6) AS pitch, count(*) AS n
FROM f JOIN a USING (rec_id, t) JOIN (SELECT rec_id, quantile_cont(v, 0.95) / 100 AS least FROM a GROUP BY rec_id) g USING (rec_id) WHERE f.v > 0 AND a.v >= g.least GROUP BY rec_id""",
         P, "f AS (SELECT rec_id, round(t, 2) AS t, min(v) AS v FROM p WHERE label = 'barrel_f0' GROUP BY ALL)", "a AS (SELECT rec_id, round(t, 2) AS t, min(v) AS v FROM p WHERE label = 'barrel_ampl' GROUP BY ALL)"),
)
def loud_reference_pitch(spark: SparkSession, d: str) -> DataFrame:
    """Reference pitch of each recording, frames that are hardly louder than nothing left out."""
    p = views.points(spark, d).withColumn("t", F.round("t", 2))
    f, a = (p.filter(F.col("label") == c).groupBy("rec_id", "t").agg(F.min("v").alias(v)) for c, v in (("barrel_f0", "f0"), ("barrel_ampl", "ampl")))
    least = a.groupBy("rec_id").agg((F.percentile("ampl", 0.95) / 100).alias("least"))
    x = f.filter("f0 > 0").join(a, ["rec_id", "t"]).join(least, "rec_id").filter("ampl >= least")
    return rounded(x.groupBy("rec_id").agg((exprs.circular_mean(exprs.semitones("f0") * (2 * math.pi)) / (2 * math.pi)).alias("pitch"), F.count("*").alias("n")), 6, "pitch")


@registry.query(
    "sounding_sides",
    _sql("""SELECT note_key, channel, sound_start, coalesce(min(t) FILTER (b >= thr2 AND v < thr2 AND t >= mid), note_end) AS sound_end FROM (
  SELECT *, sqrt(greatest(min(v) FILTER (t >= sound_start) OVER (PARTITION BY note_key), 0) * greatest(top, 0)) AS thr2 FROM (
    SELECT *, coalesce(max(t) FILTER (b < thr AND v >= thr AND t <= mid) OVER (PARTITION BY note_key), note_start) AS sound_start FROM (SELECT *, sqrt(greatest(low, 0) * greatest(top, 0)) AS thr FROM (
      SELECT *, lag(v) OVER (PARTITION BY note_key ORDER BY t) AS b, min(v) FILTER (t <= mid) OVER (PARTITION BY note_key) AS low, quantile_cont(CASE WHEN t BETWEEN note_start AND note_end THEN v END, 0.99) OVER (PARTITION BY note_key) AS top
      FROM (SELECT *, min(channel) OVER (PARTITION BY note_key) AS first FROM j) WHERE channel = first)))) GROUP BY note_key, channel, sound_start, note_end""",
         P, N, """a AS (SELECT file, label AS channel, t, min(v) AS v FROM p WHERE label IN ('barrel_ampl', 'farfield_ampl') GROUP BY ALL)""",
         """j AS (SELECT n.note_key, n."start" AS note_start, n."end" AS note_end, (n."start" + n."end") / 2 AS mid, a.channel, a.t, a.v FROM n JOIN a ON a.file = n.file AND a.t BETWEEN n."start" - 0.1 AND n."end" + 0.1)"""),
)
def sounding_sides(spark: SparkSession, d: str) -> DataFrame:
    """Where the sound of each note sets in and ends, each side by its own threshold, at the barrel or, without it, far away."""
    p = views.points(spark, d).filter("label IN ('barrel_ampl', 'farfield_ampl')").groupBy("file", F.col("label").alias("channel"), "t").agg(F.min("v").alias("v"))
    return derive.sounding_sides(p, views.notes(spark, d).select("file", "note_key", "start", "end"), ["file"], "note_key", 0.1)


@registry.query(
    "mouth_events",
    _sql("""SELECT n.note_key, max(e.t) AS rise_t, round(n."start" - max(e.t), 6) AS lead FROM n JOIN e ON e.file = n.file AND e.t BETWEEN n."start" - 0.5 AND n."start" GROUP BY n.note_key, n."start" """,
         P, N, "m AS (SELECT file, t, max(v) AS v FROM p WHERE label = 'mouth_dc' GROUP BY ALL)", "g AS (SELECT file, quantile_cont(v, 0.01) + (quantile_cont(v, 0.95) - quantile_cont(v, 0.01)) / 10 AS thr FROM m GROUP BY file)",
         "e AS (SELECT file, t FROM (SELECT m.*, lag(v) OVER (PARTITION BY file ORDER BY t) AS b FROM m) JOIN g USING (file) WHERE b < thr AND v >= thr)"),
)
def mouth_events(spark: SparkSession, d: str) -> DataFrame:
    """The last rise of the pressure in the mouth, above a tenth of its range, in the half second before each note."""
    m = views.points(spark, d).filter("label = 'mouth_dc'").groupBy("file", "t").agg(F.max("v").alias("v"))
    q = F.percentile("v", F.array(F.lit(0.01), F.lit(0.95)))
    thr = m.groupBy("file").agg(q.alias("q")).select("file", (F.col("q")[0] + (F.col("q")[1] - F.col("q")[0]) / 10).alias("thr"))
    e = windows.crossings(m.join(thr, "file"), ["file"], ["t"], "v", "thr", 64.0).filter("direction = 'up'").select("file", "t")
    n = views.notes(spark, d).select("file", "note_key", F.col("start").alias("note_start"), (F.col("start") - 0.5).alias("start"), F.col("start").alias("end"))
    x = intervals.interval_join(e, n, ["file"]).groupBy("note_key", "note_start").agg(F.max("t").alias("rise_t"))
    return rounded(x.select("note_key", "rise_t", (F.col("note_start") - F.col("rise_t")).alias("lead")), 6, "lead")


@registry.query(
    "beat_warp_margin",
    _sql("""SELECT p.series_id, p.frame_idx, k.ver_id, round(CASE WHEN p.t < k."start" THEN p.t - k."start" WHEN p.t > k."end" THEN 1 + p.t - k."end" ELSE (p.t - k."start") / (k."end" - k."start") END, 6) AS beat FROM p JOIN k ON k.file = p.file AND p.t BETWEEN k."start" - 1 AND k."end" + 1 WHERE p.label = 'mouth_dc' AND k."end" > k."start" """, P, K),
)
def beat_warp_margin(spark: SparkSession, d: str) -> DataFrame:
    """Readings on a clock on which a take lasts from 0 to 1, with a second of lead-in and lead-out in seconds."""
    p = views.points(spark, d).filter("label = 'mouth_dc'").select("series_id", "frame_idx", "file", "t")
    k = views.takes(spark, d).filter("end > start").select("file", "ver_id", F.col("start").alias("a"), F.col("end").alias("b"), (F.col("start") - 1).alias("start"), (F.col("end") + 1).alias("end"))
    j = intervals.interval_join(p, k, ["file"])
    t, a, b = F.col("t"), F.col("a"), F.col("b")
    beat = F.when(t < a, t - a).when(t > b, 1 + t - b).otherwise((t - a) / (b - a))
    return rounded(j.select("series_id", "frame_idx", "ver_id", beat.alias("beat")), 6, "beat")


# Spectra of frames of readings

_LOW = 4
_KERNEL = f"(1 + 2 * (cos(2 * pi() * (o.o / {_LOW}.0 - g.place / {_WINDOW}.0)) + 0.5 * cos(4 * pi() * (o.o / {_LOW}.0 - g.place / {_WINDOW}.0)))) / {_WINDOW}"


@registry.query("low_pass", "WITH " + R.replace("FROM readings\n  WHERE", "FROM readings\n  WHERE label = 'reed_dc' AND") + ", " + _FRAMED + f" SELECT series_id, frame, CAST(o.o AS INT) AS place, round(sum(v * {_KERNEL}), 4) AS dc FROM g CROSS JOIN (SELECT unnest(range({_LOW})) AS o) o WHERE held = {_WINDOW} GROUP BY ALL")
def low_pass(spark: SparkSession, d: str) -> DataFrame:
    """The slow part of each frame at a quarter of its clock, by cutting its spectrum."""
    f = _framed(views.readings(spark, d).filter("label = 'reed_dc'"))
    g = f.groupBy("series_id", "frame").agg(F.sort_array(F.collect_list(F.struct("place", "v"))).alias("s"))
    x = g.select("series_id", "frame", F.posexplode(signals.frame_low_pass(F.col("s.v"), _WINDOW // _LOW)).alias("place", "dc"))
    return rounded(x, 4, "dc")


_HARMONIC = f"h AS (SELECT series_id, frame, k.k, 2.0 / {_WINDOW} * sum(v * cos(2 * pi() * k.k * place / {_WINDOW})) AS re, -2.0 / {_WINDOW} * sum(v * sin(2 * pi() * k.k * place / {_WINDOW})) AS im FROM g CROSS JOIN (SELECT unnest([1, 2, 3]) AS k) k WHERE held = {_WINDOW} GROUP BY ALL)"


@registry.query(
    "harmonics_of_frames",
    "WITH " + R.replace("FROM readings\n  WHERE", "FROM readings\n  WHERE label = 'reed_dc' AND") + ", " + _FRAMED + ", " + _HARMONIC + """
SELECT h.series_id, h.frame, CAST(h.k AS INT) AS k, round(sqrt(h.re * h.re + h.im * h.im), 4) AS size, CASE WHEN sqrt(h.re * h.re + h.im * h.im) > 0.05 AND sqrt(f.re * f.re + f.im * f.im) > 0.05 THEN round(cos(atan2(h.im, h.re) - h.k * atan2(f.im, f.re)), 2) END AS phase_cos
FROM h JOIN h f ON f.series_id = h.series_id AND f.frame = h.frame AND f.k = 1""",
)
def harmonics_of_frames(spark: SparkSession, d: str) -> DataFrame:
    """Size of the first three harmonics of each frame, and the cosine of their phase relative to the first, where both are more than nothing."""
    f = _framed(views.readings(spark, d).filter("label = 'reed_dc'"))
    h = signals.frame_harmonics(f, ["series_id", "frame"], "place", "v", _WINDOW, 3)
    base = h.filter("k = 1").select("series_id", "frame", F.col("re").alias("re1"), F.col("im").alias("im1"))
    size, first = F.hypot("re", "im"), F.hypot("re1", "im1")
    turn = F.cos(F.atan2("im", "re") - F.col("k") * F.atan2("im1", "re1"))
    x = h.join(base, ["series_id", "frame"]).select("series_id", "frame", "k", size.alias("size"), F.when((size > 0.05) & (first > 0.05), turn).alias("phase_cos"))
    return rounded(rounded(x, 4, "size"), 2, "phase_cos")


@registry.query(
    "harmonic_ratios",
    _sql("""SELECT a.rec_id, a.second, a.k, round(sqrt((a.re * a.re + a.im * a.im) / (b.re * b.re + b.im * b.im)), 4) AS ratio FROM c a JOIN c b ON a.rec_id = b.rec_id AND a.second = b.second AND a.k = b.k AND a.label = 'barrel_ampl' AND b.label = 'external_ampl' WHERE b.re * b.re + b.im * b.im > 0.01""",
         P, "c AS (SELECT rec_id, label, CAST(floor(t) AS BIGINT) AS second, CAST(k.k AS INT) AS k, 2 * avg(v * cos(2 * pi() * k.k * t)) AS re, -2 * avg(v * sin(2 * pi() * k.k * t)) AS im FROM p CROSS JOIN (SELECT unnest([1, 2, 3]) AS k) k WHERE label IN ('barrel_ampl', 'external_ampl') GROUP BY ALL)"),
)
def harmonic_ratios(spark: SparkSession, d: str) -> DataFrame:
    """Size of the transfer between two channels at each of three harmonics of one hertz, for each second."""
    p = views.points(spark, d).filter("label IN ('barrel_ampl', 'external_ampl')").withColumn("second", F.floor("t"))
    c = signals.heterodyne(p, ["rec_id", "second", "label"], "t", "v", [1.0, 2.0, 3.0])
    c = c.select("rec_id", "second", "label", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), (F.col(f"re_{k}") * F.col(f"re_{k}") + F.col(f"im_{k}") * F.col(f"im_{k}")).alias("square")) for k in (1, 2, 3)])).alias("h"))
    a, b = (c.filter(F.col("label") == label).select("rec_id", "second", "h.k", F.col("h.square").alias(s)) for label, s in (("barrel_ampl", "a"), ("external_ampl", "b")))
    return rounded(a.join(b, ["rec_id", "second", "k"]).filter("b > 0.01").select("rec_id", "second", "k", F.sqrt(F.col("a") / F.col("b")).alias("ratio")), 4, "ratio")


# Marks


@registry.query(
    "quadratic_ticks",
    _sql("""SELECT video, marker_id, n, round(a - b * far + c * far * far, 3) AS before, round(a + b * far + c * far * far, 3) AS after FROM (
  SELECT video, marker_id, n, y1 / s2 AS b, (n * y2 - s2 * y0) / (n * s4 - s2 * s2) AS c, (s4 * y0 - s2 * y2) / (n * s4 - s2 * s2) AS a, 1 + 10.0 / (n - 1) AS far FROM (
    SELECT video, marker_id, count(*) AS n, sum(u * u) AS s2, sum(u * u * u * u) AS s4, sum(x) AS y0, sum(u * x) AS y1, sum(u * u * x) AS y2 FROM (
      SELECT video, marker_id, CAST(x AS DOUBLE) AS x, 2.0::DOUBLE * (row_number() OVER (PARTITION BY video, marker_id ORDER BY msec, mark_id) - 1) / (count(*) OVER (PARTITION BY video, marker_id) - 1) - 1 AS u, count(*) OVER (PARTITION BY video, marker_id) AS held FROM m WHERE marker_id IS NOT NULL) WHERE held >= 3 GROUP BY ALL))""", M),
)
def quadratic_ticks(spark: SparkSession, d: str) -> DataFrame:
    """Places of the detections of each marker as a parabola of their number, carried on five beyond either end."""
    m = views.marks(spark, d).filter("marker_id IS NOT NULL")
    return rounded(stats.quadratic(m, ["video", "marker_id"], ["msec", "mark_id"], "x"), 3, "before", "after")


_MARKERS = (3, 5, 11, 25, 40)


@registry.query(
    "centre_tensor",
    _sql("SELECT video, CAST(floor(msec / 1000) AS BIGINT) AS second, " + ", ".join(f"round(avg(x + w / 2) FILTER (marker_id = {i}), 4) AS x_{i}, round(avg(y + h / 2) FILTER (marker_id = {i}), 4) AS y_{i}" for i in _MARKERS) + " FROM m WHERE msec IS NOT NULL GROUP BY ALL", M),
)
def centre_tensor(spark: SparkSession, d: str) -> DataFrame:
    """Centres of the markers for each second of each video, one pair of columns for each; null where one isn't seen."""
    m = views.marks(spark, d).filter(present("msec")).withColumn("second", F.floor(F.col("msec") / 1000))
    x, y = F.col("x") + F.col("w") / 2, F.col("y") + F.col("h") / 2
    g = m.groupBy("video", "second").pivot("marker_id", list(_MARKERS)).agg(F.avg(x).alias("x"), F.avg(y).alias("y"))
    g = g.withColumnsRenamed({f"{i}_{c}": f"{c}_{i}" for i in _MARKERS for c in "xy"})
    return rounded(g, 4, *[f"{c}_{i}" for i in _MARKERS for c in "xy"])


@registry.query(
    "marker_pairs",
    _sql("""SELECT a.video, a.second, round(degrees(atan((b.y - a.y) / nullif(b.x - a.x, 0))), 4) AS angle, round(sqrt(pow(b.x - a.x, 2) + pow(b.y - a.y, 2)), 4) AS apart, round(((c.x - a.x) * (b.x - a.x) + (c.y - a.y) * (b.y - a.y)) / nullif(sqrt(pow(b.x - a.x, 2) + pow(b.y - a.y, 2)), 0), 4) AS along
FROM e a JOIN e b ON b.video = a.video AND b.second = a.second AND a.marker_id = 3 AND b.marker_id = 5 LEFT JOIN e c ON c.video = a.video AND c.second = a.second AND c.marker_id = 11""",
         M, "e AS (SELECT video, CAST(floor(msec / 1000) AS BIGINT) AS second, marker_id, avg(x + w / 2) AS x, avg(y + h / 2) AS y FROM m WHERE marker_id IS NOT NULL AND msec IS NOT NULL GROUP BY ALL)"),
)
def marker_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Angle and distance of one marker from another for each second, and how far a third lies along the line through them."""
    m = views.marks(spark, d).filter(F.col("marker_id").isNotNull() & present("msec"))
    e = m.groupBy("video", F.floor(F.col("msec") / 1000).alias("second"), "marker_id").agg(F.avg(F.col("x") + F.col("w") / 2).alias("x"), F.avg(F.col("y") + F.col("h") / 2).alias("y"))
    a, b, c = (e.filter(F.col("marker_id") == i).select("video", "second", F.col("x").alias(f"x{i}"), F.col("y").alias(f"y{i}")) for i in (3, 5, 11))
    x = a.join(b, ["video", "second"]).join(c, ["video", "second"], "left")
    x = x.select("video", "second", exprs.segment_angle(F.col("x5") - F.col("x3"), F.col("y5") - F.col("y3")).alias("angle"), exprs.distance("x3", "y3", "x5", "y5").alias("apart"), exprs.along_line("x11", "y11", "x3", "y3", "x5", "y5").alias("along"))
    return rounded(x, 4, "angle", "apart", "along")


@registry.query(
    "strip_lengths",
    _sql("SELECT m.mark_id, " + settled_sql("m.w * m.h / nullif(g.side, 0) * 5 / nullif(g.side, 0)", 5) + " AS mm FROM m JOIN (SELECT video, marker_id, CAST(quantile_cont(least(w, h), 0.5) AS DOUBLE) AS side FROM m WHERE marker_id IS NOT NULL GROUP BY ALL) g ON g.video = m.video AND g.marker_id = m.marker_id", M),
)
def strip_lengths(spark: SparkSession, d: str) -> DataFrame:
    """Length in mm of the strip of each mark: its area over its marker's usual width, by the same as a scale of 5 mm."""
    m = views.marks(spark, d).filter("marker_id IS NOT NULL")
    side = m.groupBy("video", "marker_id").agg(F.percentile(F.least("w", "h"), 0.5).alias("side"))
    x = m.join(side, ["video", "marker_id"]).select("mark_id", video.strip_length(F.col("w") * F.col("h"), "side", "side").alias("mm"))
    return settled(x, 5, "mm")


@registry.query("greedy_corners")
def greedy_corners(spark: SparkSession, d: str) -> DataFrame:
    """Marks found by template matched one to one with those found by code within each two seconds of a video, nearest first."""
    m = views.marks(spark, d).filter(present("msec")).withColumn("window", F.floor(F.col("msec") / 2000)).withColumn("side", (F.col("source") == "template").cast("int"))
    return rounded(sequences.greedy_corners(m, ["video", "window"], "side", "mark_id", "x", "y"), 6, "distance")


@registry.query("greedy_corners_blocks")
def greedy_corners_blocks(spark: SparkSession, d: str) -> DataFrame:
    """The same by the sum of the differences along both axes."""
    m = views.marks(spark, d).filter(present("msec")).withColumn("window", F.floor(F.col("msec") / 2000)).withColumn("side", (F.col("source") == "template").cast("int"))
    return sequences.greedy_corners(m, ["video", "window"], "side", "mark_id", "x", "y", cost=lambda p, q: np.abs(q - p).sum(axis=1))


# Audio of recordings


@registry.query("audio_descriptors")
def audio_descriptors(spark: SparkSession, d: str) -> DataFrame:
    """All descriptors of the channels of each recording, made into an audio file and read back in blocks."""
    b = wav.read_blocks(spark, audio_files(spark, d), block=256, overlap=64)
    x = signals.describe(b, size=64, hop=32, fmin=1.0, fmax=12.0, count=3)
    return rounded(x.withColumn("path", F.regexp_extract("path", r"([^/]+)$", 1)), 6, "t", "v", "v_im")


@registry.query("audio_peaks")
def audio_peaks(spark: SparkSession, d: str) -> DataFrame:
    """Peaks of the spectrum of those files."""
    b = wav.read_blocks(spark, audio_files(spark, d), block=512, overlap=64)
    x = audio.spectral_peaks(b, size=64, around_hz=3.0, around_s=0.5, percentile=90.0, fmin=1.0, fmax=50.0)
    return x.withColumns({"path": F.regexp_extract("path", r"([^/]+)$", 1), "power": F.round("power", 6)})


@registry.query("audio_regions")
def audio_regions(spark: SparkSession, d: str) -> DataFrame:
    """Regions of those files that sound, by the power between two frequencies."""
    b = wav.read_blocks(spark, audio_files(spark, d), block=512, overlap=64)
    x = audio.sounding_regions(audio.band_power(b, size=64, fmin=1.0, fmax=50.0), 0.5)
    return x.withColumn("path", F.regexp_extract("path", r"([^/]+)$", 1))


@registry.query("audio_delays")
def audio_delays(spark: SparkSession, d: str) -> DataFrame:
    """Delay between the first two channels of each of those files, by several chunks of the first that are found in the second: the best one's vote."""
    b = wav.read_blocks(spark, audio_files(spark, d), block=256, overlap=128).withColumn("path", F.regexp_extract("path", r"([^/]+)$", 1))
    return rounded(audio.chunk_delays(b.filter("channel = 0"), b.filter("channel = 1"), ["path"], 128, 3), 6, "correlation")
