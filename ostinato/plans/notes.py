"""Queries on notes, takes and scores."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ostinato.functions import exprs
from ostinato.operators import derive, intervals, stats, windows
from ostinato.plans import views
from ostinato.plans.registry import Registry
from ostinato.plans.views import K, N, P, path_sql, rounded
from ostinato.session import broadcast_if_small, path_key, table

registry = Registry()


def _sql(text: str, *ctes: str) -> str:
    return "WITH " + ", ".join(ctes) + "\n" + text


# Statistics within notes and takes

_STATS = ["avg", "var", "trend", "max_t", "max_v", "min_t", "min_v", "t1", "t2", "t3"]
_THIRD = 'greatest(1, least(3, CAST(floor(3 * (p.t - x."start") / nullif(x."end" - x."start", 0)) AS INT) + 1))'


def _stats_sql(key: str, source: str) -> str:
    thirds = ", ".join(f"CAST(sum(CAST(p.v AS DECIMAL(28, 6))) FILTER ({_THIRD} = {i}) AS DOUBLE) / nullif(count(*) FILTER ({_THIRD} = {i}), 0) AS t{i}" for i in (1, 2, 3))
    return f"""
SELECT x.{key}, p.label, count(*) AS n, round(quantile_cont(p.v, 0.5), 8) AS avg, round(quantile_cont(p.v, 0.75) - quantile_cont(p.v, 0.25), 8) AS var,
  round(regr_slope(p.v, p.t), 4) AS trend, min(p.t) FILTER (p.v = m.hi) AS max_t, max(p.v) AS max_v, min(p.t) FILTER (p.v = m.lo) AS min_t, min(p.v) AS min_v, {thirds}
FROM {source} x JOIN p ON p.file = x.file AND p.t BETWEEN x."start" AND x."end"
JOIN (SELECT y.{key}, p.label, max(p.v) AS hi, min(p.v) AS lo FROM {source} y JOIN p ON p.file = y.file AND p.t BETWEEN y."start" AND y."end" GROUP BY ALL) m ON m.{key} = x.{key} AND m.label = p.label
GROUP BY x.{key}, p.label"""


def _interval_stats(spark: SparkSession, d: str, spans: DataFrame, key: str) -> DataFrame:
    p = views.points(spark, d).select("file", "label", "t", "v")
    joined = intervals.interval_join(p, spans.select(key, "file", "start", "end"), ["file"])
    x = stats.base_stats(joined.withColumns({"__s": F.col("start"), "__e": F.col("end")}), [key, "label"])
    return rounded(rounded(x, 8, "avg", "var"), 4, "trend")


@registry.query("note_base_stats", _sql(_stats_sql("note_key", "n"), P, N))
def note_base_stats(spark: SparkSession, d: str) -> DataFrame:
    """Ten statistics of each series within each note."""
    return _interval_stats(spark, d, views.notes(spark, d), "note_key")


@registry.query("clip_stats", _sql(_stats_sql("ver_id", "k"), P, K))
def clip_stats(spark: SparkSession, d: str) -> DataFrame:
    """The same within each take."""
    return _interval_stats(spark, d, views.takes(spark, d), "ver_id")


@registry.query(
    "note_thirds",
    _sql(f'SELECT x.note_key, p.label, {_THIRD} AS third, round(quantile_cont(p.v, 0.5), 8) AS median, count(*) AS n FROM n x JOIN p ON p.file = x.file AND p.t BETWEEN x."start" AND x."end" GROUP BY ALL', P, N),
)
def note_thirds(spark: SparkSession, d: str) -> DataFrame:
    """Median of each third of each note."""
    p = views.points(spark, d).select("file", "label", "t", "v")
    j = intervals.interval_join(p, views.notes(spark, d).select("note_key", "file", "start", "end"), ["file"])
    x = j.groupBy("note_key", "label", stats.third_of("t", "start", "end").alias("third")).agg(F.percentile("v", 0.5).alias("median"), F.count("*").alias("n"))
    return rounded(x, 8, "median")


@registry.query(
    "feature_pivot",
    _sql("SELECT x.note_key, " + ", ".join(f"round(quantile_cont(p.v, 0.5) FILTER (p.label = '{c}'), 8) AS {c}" for c in ("barrel_f0", "barrel_ampl", "mouth_dc")) + ' FROM n x JOIN p ON p.file = x.file AND p.t BETWEEN x."start" AND x."end" WHERE p.label IN (\'barrel_f0\', \'barrel_ampl\', \'mouth_dc\') GROUP BY ALL', P, N),
)
def feature_pivot(spark: SparkSession, d: str) -> DataFrame:
    """Medians of notes, one column for each label."""
    labels = ["barrel_f0", "barrel_ampl", "mouth_dc"]
    p = views.points(spark, d).select("file", "label", "t", "v").filter(F.col("label").isin(labels))
    j = intervals.interval_join(p, views.notes(spark, d).select("note_key", "file", "start", "end"), ["file"])
    return rounded(j.groupBy("note_key").pivot("label", labels).agg(F.percentile("v", 0.5)), 8, *labels)


_RE, _IM = "p.v * cos(2 * pi() * p.t)", "p.v * sin(2 * pi() * p.t)"


@registry.query(
    "complex_angle_stats",
    _sql("""SELECT note_key, any_value(n) AS n, round(any_value(abs_avg), 6) AS abs_avg, round(any_value(abs_var), 6) AS abs_var, round(any_value(arg_avg), 6) AS arg_avg,
  round(quantile_cont(dev, 0.75) - quantile_cont(dev, 0.25), 5) AS arg_var, round(regr_slope(dev, t), 3) AS arg_trend
FROM (SELECT j.*, c.n, c.abs_avg, c.abs_var, c.arg_avg, (((CASE WHEN re <> 0 OR im <> 0 THEN atan2(im, re) END - c.arg_avg + pi()) % (2 * pi())) + 2 * pi()) % (2 * pi()) - pi() AS dev FROM j JOIN c USING (note_key)) GROUP BY note_key""",
         P, N, f'j AS (SELECT x.note_key, p.t, {_RE} AS re, {_IM} AS im FROM n x JOIN p ON p.file = x.file AND p.t BETWEEN x."start" AND x."end" WHERE p.label = \'barrel_ampl\')',
         "c AS (SELECT note_key, count(*) AS n, quantile_cont(sqrt(re * re + im * im), 0.5) AS abs_avg, quantile_cont(sqrt(re * re + im * im), 0.75) - quantile_cont(sqrt(re * re + im * im), 0.25) AS abs_var, atan2(quantile_cont(im, 0.5), quantile_cont(re, 0.5)) AS arg_avg FROM j GROUP BY note_key)"),
)
def complex_angle_stats(spark: SparkSession, d: str) -> DataFrame:
    """Statistics of a complex series, made from an amplitude turning once a second, within notes."""
    p = views.points(spark, d).filter("label = 'barrel_ampl'")
    turn = 2 * math.pi * F.col("t")
    p = p.select("file", "t", (F.col("v") * F.cos(turn)).alias("re"), (F.col("v") * F.sin(turn)).alias("im"))
    j = intervals.interval_join(p, views.notes(spark, d).select("note_key", "file", "start", "end"), ["file"])
    x = stats.angle_stats(j, ["note_key"])
    return rounded(rounded(rounded(x, 6, "abs_avg", "abs_var", "arg_avg"), 5, "arg_var"), 3, "arg_trend")


# Joins of notes, takes, scores


@registry.query(
    "note_in_clip_midpoint",
    _sql('SELECT n.note_key, k.ver_id FROM n JOIN k ON k.file = n.file AND (n."start" + n."end") / 2 BETWEEN k."start" AND k."end"', N, K),
)
def note_in_clip_midpoint(spark: SparkSession, d: str) -> DataFrame:
    n = views.notes(spark, d).select("note_key", "file", "start", "end")
    return intervals.midpoint_join(n, _outer(spark, d), ["file"]).select("note_key", "ver_id")


def _outer(spark: SparkSession, d: str) -> DataFrame:
    return views.takes(spark, d).select("ver_id", "file", F.col("start").alias("outer_start"), F.col("end").alias("outer_end"))


@registry.query(
    "note_in_clip_left",
    _sql("""SELECT n.note_key, k.ver_id,
  CASE WHEN n.note_label IS NULL OR NOT regexp_matches(n.note_label, '^\\s*\\d') THEN 1 ELSE 0 END + CASE WHEN k.ver_id IS NULL THEN 8 ELSE 0 END
  + CASE WHEN n.f0 IS NULL THEN 16 ELSE 0 END + CASE WHEN n.ampl IS NULL THEN 32 ELSE 0 END AS err
FROM n LEFT JOIN k ON k.file = n.file AND (n."start" + n."end") / 2 > k."start" AND (n."start" + n."end") / 2 < k."end" """, N, K),
)
def note_in_clip_left(spark: SparkSession, d: str) -> DataFrame:
    """Every note with its take, if any, and what it lacks as bits: 1 number, 8 take, 16 frequency, 32 amplitude."""
    n = views.notes(spark, d).select("note_key", "file", "start", "end", "note_label", "f0", "ampl")
    x = intervals.midpoint_join(n, _outer(spark, d), ["file"], how="left", closed="neither")
    return x.select("note_key", "ver_id", derive.error_bits({1: exprs.leading_number("note_label").isNull(), 8: F.col("ver_id").isNull(), 16: F.col("f0").isNull(), 32: F.col("ampl").isNull()}).alias("err"))


@registry.query("contained_notes", _sql('SELECT n.note_key, k.ver_id FROM n JOIN k ON k.file = n.file AND n."start" > k."start" AND n."end" < k."end"', N, K))
def contained_notes(spark: SparkSession, d: str) -> DataFrame:
    n = views.notes(spark, d).select("note_key", "file", "start", "end")
    return intervals.contained(n, _outer(spark, d), ["file"]).select("note_key", "ver_id")


@registry.query(
    "nearest_clip",
    _sql("""SELECT note_key, ver_id FROM (SELECT n.note_key, k.ver_id, row_number() OVER (PARTITION BY n.note_key ORDER BY greatest(k."start" - n."start", n."start" - k."end", 0), k."start", k.ver_id) AS i FROM n JOIN k ON k.file = n.file) WHERE i = 1""", N, K),
)
def nearest_clip(spark: SparkSession, d: str) -> DataFrame:
    """The take nearest to the start of each note."""
    n = views.notes(spark, d).select("note_key", "file", F.col("start").alias("t"))
    k = views.takes(spark, d).select("file", "start", "end", "ver_id")
    return intervals.nearest_interval(n, k, ["file"], "ver_id").filter("ver_id IS NOT NULL").select("note_key", "ver_id")


@registry.query(
    "frame_labels_last_wins",
    _sql('SELECT p.series_id, p.frame_idx, max_by(n.note_id, (n."start", n.note_key)) AS note_id FROM p LEFT JOIN n ON n.file = p.file AND p.t BETWEEN n."start" AND n."end" WHERE p.label = \'barrel_f0\' GROUP BY ALL', P, N),
)
def frame_labels_last_wins(spark: SparkSession, d: str) -> DataFrame:
    """Number of the note each frame belongs to; of two notes that touch the later one."""
    p = views.points(spark, d).filter("label = 'barrel_f0'").select("series_id", "frame_idx", "file", "t")
    n = views.notes(spark, d).select("file", "start", "end", "note_key", F.struct("start", "note_key").alias("place"), "note_id")
    return intervals.last_wins(p, n, ["file"], ["series_id", "frame_idx"], "place", ["note_id"]).select("series_id", "frame_idx", "note_id")


@registry.query(
    "asof_next_marker",
    _sql('SELECT k.ver_id, q."start" AS mark_t, q.note_key FROM k ASOF LEFT JOIN (SELECT file, "start", max(note_key) AS note_key FROM n GROUP BY ALL) q ON q.file = k.file AND k."start" <= q."start"', N, K),
)
def asof_next_marker(spark: SparkSession, d: str) -> DataFrame:
    """The first note at or after the start of each take."""
    k = views.takes(spark, d).select("ver_id", "file", F.col("start").alias("t"))
    m = views.notes(spark, d).select("file", F.col("start").alias("mark_t"), "note_key")
    return intervals.asof(k, m, ["file"], ["note_key"], "forward").select("ver_id", "mark_t", "note_key")


@registry.query(
    "full_outer_boundaries",
    _sql("""SELECT coalesce(a.file, b.file, c.file) AS file, a.n_notes, b.n_takes, c.n_videos,
  (coalesce(a.first, 0) + coalesce(b.first, 0)) / nullif((a.first IS NOT NULL)::INT + (b.first IS NOT NULL)::INT, 0) AS mean_first
FROM (SELECT file, count(*) AS n_notes, min("start") AS first FROM n GROUP BY file) a
FULL JOIN (SELECT file, count(*) AS n_takes, min("start") AS first FROM k GROUP BY file) b ON a.file = b.file
FULL JOIN (SELECT """ + path_sql("signal_file") + """ AS file, count(*) AS n_videos FROM (SELECT DISTINCT signal_file, video_file FROM wav_video_delays) GROUP BY 1) c ON c.file = coalesce(a.file, b.file)""", N, K),
)
def full_outer_boundaries(spark: SparkSession, d: str) -> DataFrame:
    """What notes, takes and videos have of each file; the mean of the first times that are known."""
    a = views.notes(spark, d).groupBy("file").agg(F.count("*").alias("n_notes"), F.min("start").alias("first_a"))
    b = views.takes(spark, d).groupBy("file").agg(F.count("*").alias("n_takes"), F.min("start").alias("first_b"))
    c = table(spark, d, "wav_video_delays").select("signal_file", "video_file").distinct().groupBy(path_key("signal_file").alias("file")).agg(F.count("*").alias("n_videos"))
    x = a.join(b, "file", "full").join(c, "file", "full")
    return x.select("file", "n_notes", "n_takes", "n_videos", derive.mean_of_known("first_a", "first_b").alias("mean_first"))


@registry.query(
    "version_left_join_blank",
    _sql("SELECT n.note_key, k.ver_id, k.tune FROM n LEFT JOIN (SELECT * FROM k WHERE tune IN ('copper_reel', 'paper_boats', 'third_lamp')) k ON k.file = n.file AND k.ver_nbr = n.ver_nbr", N, K),
)
def version_left_join_blank(spark: SparkSession, d: str) -> DataFrame:
    """Notes with their take; takes of other tunes than the kept ones count as absent."""
    k = views.takes(spark, d).filter(F.col("tune").isin("copper_reel", "paper_boats", "third_lamp")).select("ver_id", "file", "ver_nbr", "tune")
    return views.notes(spark, d).select("note_key", "file", "ver_nbr").join(k, ["file", "ver_nbr"], "left").select("note_key", "ver_id", "tune")


_PITCH = r"regexp_extract(note_label, '-\s*([A-G]#?\d)\s*$', 1)"
_SCORE = f"""score AS (
  SELECT tune, note_id, pitch FROM (SELECT tune, note_id, {_PITCH} AS pitch, count(*) AS c FROM n WHERE {_PITCH} <> '' GROUP BY ALL)
  QUALIFY row_number() OVER (PARTITION BY tune, note_id ORDER BY c DESC, pitch) = 1
)"""
_MIDI = "(CAST(right(pitch, 1) AS INT) + 1) * 12 + list_position(['C', 'C#', 'D', 'D#', 'E', 'F', 'F#', 'G', 'G#', 'A', 'A#', 'B'], left(pitch, length(pitch) - 1)) - 1"


def _score(spark: SparkSession, d: str) -> DataFrame:
    """The written pitch of each note of each tune: the most frequent one of its labels."""
    n = views.notes(spark, d).withColumn("pitch", F.nullif(F.regexp_extract("note_label", r"-\s*([A-G]#?\d)\s*$", 1), F.lit("")))
    return stats.most_frequent(n, ["tune", "note_id"], "pitch")


@registry.query(
    "score_inner_join",
    _sql(f"SELECT n.note_key, s.pitch, {_MIDI} AS midi, round(1200 * log2(n.f0 / (440 * pow(2, ({_MIDI} - 69) / 12.0))) + 200, 5) AS cents FROM n JOIN score s ON s.tune = n.tune AND s.note_id = n.note_id", N, _SCORE),
)
def score_inner_join(spark: SparkSession, d: str) -> DataFrame:
    """Notes with the score's pitch and their deviation from it in cents."""
    s = _score(spark, d).withColumn("midi", exprs.name_to_midi("pitch"))
    x = views.notes(spark, d).select("note_key", "tune", "note_id", "f0").join(broadcast_if_small(s), ["tune", "note_id"])
    return rounded(x.select("note_key", "pitch", "midi", exprs.cents("f0", exprs.midi_to_hz("midi")).alias("cents")), 5, "cents")


@registry.query(
    "substring_join",
    f"""WITH t AS (SELECT DISTINCT tune FROM recordings WHERE trim(tune) <> ''), f AS (SELECT DISTINCT {path_sql('filename')} AS file FROM recordings)
SELECT file, min(tune) AS tune FROM f JOIN t ON contains(file, '/' || replace(tune, '_', '') || '_r') GROUP BY file""",
)
def substring_join(spark: SparkSession, d: str) -> DataFrame:
    """Files whose name holds the name of a tune: the part that may be one is cut out, so that the join is on equality."""
    r = table(spark, d, "recordings")
    t = r.filter(F.trim("tune") != "").select("tune").distinct().withColumn("part", F.translate("tune", "_", ""))
    f = r.select(path_key("filename").alias("file")).distinct().withColumn("part", F.regexp_extract("file", r"/([^/]*)_r[^/]*$", 1))
    return f.join(broadcast_if_small(t), "part").groupBy("file").agg(F.min("tune").alias("tune"))


@registry.query("semi_has_notes", f"SELECT rec_id FROM recordings WHERE {path_sql('filename')} IN (SELECT {path_sql('wavfile')} FROM notes)")
def semi_has_notes(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "recordings").select("rec_id", path_key("filename").alias("file"))
    return r.join(table(spark, d, "notes").select(path_key("wavfile").alias("file")), "file", "left_semi").select("rec_id")


@registry.query("anti_missing_notes", f"SELECT rec_id FROM recordings WHERE {path_sql('filename')} NOT IN (SELECT {path_sql('wavfile')} FROM notes WHERE wavfile IS NOT NULL)")
def anti_missing_notes(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "recordings").select("rec_id", path_key("filename").alias("file"))
    return r.join(table(spark, d, "notes").select(path_key("wavfile").alias("file")), "file", "left_anti").select("rec_id")


@registry.query(
    "union_missing_columns",
    _sql("SELECT note_key, NULL::BIGINT AS ver_id, file, f0 FROM n UNION ALL BY NAME SELECT ver_id, file FROM k", N, K),
)
def union_missing_columns(spark: SparkSession, d: str) -> DataFrame:
    n = views.notes(spark, d).select("note_key", "file", "f0")
    return n.unionByName(views.takes(spark, d).select("ver_id", "file"), allowMissingColumns=True)


@registry.query(
    "tolerant_union",
    _sql("""SELECT file, t FROM a UNION ALL SELECT file, t FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.file = b.file AND b.t > a.t - 0.05 AND b.t < a.t + 0.05)""",
         N, K, 'a AS (SELECT DISTINCT file, "start" AS t FROM k)', 'b AS (SELECT DISTINCT file, "start" AS t FROM n)'),
)
def tolerant_union(spark: SparkSession, d: str) -> DataFrame:
    """Starts of takes, and those of notes that aren't near one."""
    a = views.takes(spark, d).select("file", F.col("start").alias("t")).distinct()
    b = views.notes(spark, d).select("file", F.col("start").alias("t")).distinct()
    return intervals.tolerant_union(a, b, ["file"], 0.05)


# Windows and groups over notes


@registry.query(
    "score_beats",
    _sql('SELECT note_key, round(coalesce(sum("end" - "start") OVER (PARTITION BY file, ver_nbr ORDER BY note_id, note_key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 6) AS beat_start FROM n', N),
)
def score_beats(spark: SparkSession, d: str) -> DataFrame:
    """Running time within each take, taking the notes one after the other."""
    w = windows.ordered(["file", "ver_nbr"], "note_id", "note_key")
    n = views.notes(spark, d)
    return rounded(n.select("note_key", windows.running_before(F.col("end") - F.col("start"), w).alias("beat_start")), 6, "beat_start")


@registry.query(
    "strong_beats",
    """WITH b AS (
  SELECT l_orderkey, l_shipdate, l_linenumber, l_partkey, l_returnflag = 'A' AS strong,
    sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_partkey) - l_quantity AS beat_start FROM lineitem
), a AS (SELECT l_orderkey, min(beat_start) FILTER (strong) AS anchor FROM b GROUP BY l_orderkey)
SELECT b.l_orderkey, b.l_shipdate, b.l_linenumber, b.l_partkey, b.beat_start, coalesce((((b.beat_start - a.anchor) % 4) + 4) % 4 = 0, FALSE) AS on_bar FROM b JOIN a USING (l_orderkey)""",
)
def strong_beats(spark: SparkSession, d: str) -> DataFrame:
    """Which notes fall on a bar of four beats counted from the first strong one; lines of an order stand for notes."""
    order = ["l_shipdate", "l_linenumber", "l_partkey"]
    x = table(spark, d, "lineitem").select("l_orderkey", *order, F.col("l_quantity").alias("beats"), (F.col("l_returnflag") == "A").alias("strong"))
    return derive.bar_positions(x, ["l_orderkey"], order, 4).select("l_orderkey", *order, "beat_start", "on_bar")


@registry.query(
    "local_tempo",
    _sql("""SELECT a.note_key, round(60 * count(*) / sum(b."end" - b."start"), 5) AS tempo, round(60 / nullif(a."end" - a."start", 0), 5) AS own_tempo
FROM n a JOIN n b ON a.file = b.file AND a.ver_nbr = b.ver_nbr AND b."end" > a."start" - 2 AND b."start" < a."end" + 2 AND b."end" > b."start" WHERE a."end" > a."start"
GROUP BY a.note_key, a."end", a."start" HAVING sum(b."end" - b."start") > 0""", N),
)
def local_tempo(spark: SparkSession, d: str) -> DataFrame:
    """Notes a minute among those within two seconds of each note, and by the note's own length."""
    n = views.notes(spark, d).filter(F.col("end") > F.col("start"))
    return rounded(derive.local_tempo(n, ["file", "ver_nbr"], "note_key", 2.0), 5, "tempo", "own_tempo")


@registry.query(
    "version_summary",
    _sql("""SELECT a.*, b.pitch FROM (SELECT file, ver_nbr, count(*) AS n_notes, round(CAST(sum(CAST(f0 AS DECIMAL(28, 6))) AS DOUBLE) / count(f0), 8) AS f0_mean, round(stddev_samp(f0), 5) AS f0_std FROM n GROUP BY ALL) a
LEFT JOIN (SELECT file, ver_nbr, pitch FROM (SELECT file, ver_nbr, """ + _PITCH + """ AS pitch, count(*) AS c FROM n WHERE """ + _PITCH + """ <> '' GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY file, ver_nbr ORDER BY c DESC, pitch) = 1) b ON a.file = b.file AND a.ver_nbr IS NOT DISTINCT FROM b.ver_nbr""", N),
)
def version_summary(spark: SparkSession, d: str) -> DataFrame:
    """Mean and sample deviation of the frequencies of each take, and its most frequent pitch."""
    n = views.notes(spark, d).withColumn("pitch", F.nullif(F.regexp_extract("note_label", r"-\s*([A-G]#?\d)\s*$", 1), F.lit("")))
    a = n.groupBy("file", "ver_nbr").agg(F.count("*").alias("n_notes"), exprs.exact_avg("f0").alias("f0_mean"), F.stddev_samp("f0").alias("f0_std"))
    x = a.join(stats.most_frequent(n, ["file", "ver_nbr"], "pitch"), ["file", "ver_nbr"], "left")
    return rounded(rounded(x, 8, "f0_mean"), 5, "f0_std")


@registry.query("clip_extent", _sql('SELECT file, ver_nbr, min("start") AS "start", max("end") AS "end", count(*) AS n_notes FROM n GROUP BY ALL', N))
def clip_extent(spark: SparkSession, d: str) -> DataFrame:
    return views.notes(spark, d).groupBy("file", "ver_nbr").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n_notes"))


@registry.query("group_mean_center", _sql("SELECT n.note_key, round(n.f0 - a.m, 6) AS centred FROM n JOIN (SELECT subject_id, CAST(sum(CAST(f0 AS DECIMAL(28, 6))) AS DOUBLE) / count(f0) AS m FROM n GROUP BY ALL) a ON a.subject_id = n.subject_id WHERE n.f0 IS NOT NULL", N))
def group_mean_center(spark: SparkSession, d: str) -> DataFrame:
    n = views.notes(spark, d).filter("f0 IS NOT NULL")
    return rounded(stats.centred(n, ["subject_id"], "f0", "mean").select("note_key", "centred"), 6, "centred")


@registry.query("group_median_center", _sql("SELECT n.note_key, round(n.f0 - a.m, 6) AS centred FROM n JOIN (SELECT subject_id, instrument, quantile_cont(f0, 0.5) AS m FROM n GROUP BY ALL) a ON a.subject_id = n.subject_id AND a.instrument = n.instrument WHERE n.f0 IS NOT NULL", N))
def group_median_center(spark: SparkSession, d: str) -> DataFrame:
    n = views.notes(spark, d).filter("f0 IS NOT NULL")
    return rounded(stats.centred(n, ["subject_id", "instrument"], "f0", "median").select("note_key", "centred"), 6, "centred")


@registry.query("group_ordinal", _sql("SELECT n.note_key, t.tune_nbr FROM n JOIN (SELECT tune, row_number() OVER (ORDER BY tune) - 1 AS tune_nbr FROM (SELECT DISTINCT tune FROM n WHERE tune IS NOT NULL)) t ON t.tune = n.tune", N))
def group_ordinal(spark: SparkSession, d: str) -> DataFrame:
    """Number of each note's tune; only the list of tunes, a dimension, is numbered in one task."""
    return derive.group_ordinal(views.notes(spark, d).select("note_key", "tune"), "tune", "tune_nbr").select("note_key", "tune_nbr")


@registry.query(
    "prev_next_context",
    _sql("""SELECT note_key, round(prev_gap, 6) AS prev_gap, round(next_gap, 6) AS next_gap, round(least(0.2, prev_gap / 2, next_gap / 2), 6) AS context FROM (
  SELECT note_key, "start" - coalesce(lag("start") OVER w, 0) AS prev_gap, coalesce(lead("end") OVER w, max("end") OVER (PARTITION BY file)) - "end" AS next_gap FROM n WINDOW w AS (PARTITION BY file ORDER BY "start", note_key))""", N),
)
def prev_next_context(spark: SparkSession, d: str) -> DataFrame:
    x = derive.neighbour_context(views.notes(spark, d), ["file"], ["start", "note_key"], 0.2)
    return rounded(x.select("note_key", "prev_gap", "next_gap", "context"), 6, "prev_gap", "next_gap", "context")


@registry.query(
    "inter_onset",
    _sql("""SELECT note_key, round(ioi, 6) AS ioi, round(("end" - "start") / nullif(ioi, 0), 6) AS sounding_share FROM (
  SELECT *, coalesce(lead("start") OVER (PARTITION BY file, ver_nbr ORDER BY "start", note_key) - "start", "end" - "start") AS ioi FROM n)""", N),
)
def inter_onset(spark: SparkSession, d: str) -> DataFrame:
    """Time to the next note of the take (the note's own length for the last), and the share of it that sounds."""
    x = derive.inter_onset(views.notes(spark, d), ["file", "ver_nbr"], ["start", "note_key"])
    return rounded(x.select("note_key", "ioi", "sounding_share"), 6, "ioi", "sounding_share")


@registry.query(
    "note_duplicates",
    "SELECT note_key, count(*) AS n FROM notes GROUP BY note_key HAVING count(*) > 1",
)
def note_duplicates(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "notes").groupBy("note_key").agg(F.count("*").alias("n")).filter("n > 1")


@registry.query(
    "rebased_times",
    _sql('SELECT note_key, round("start" - min("start") OVER (PARTITION BY file, ver_nbr), 6) AS "start", round("end" - min("start") OVER (PARTITION BY file, ver_nbr), 6) AS "end" FROM n', N),
)
def rebased_times(spark: SparkSession, d: str) -> DataFrame:
    """Times of notes from the start of their take."""
    first = F.min("start").over(Window.partitionBy("file", "ver_nbr"))
    return rounded(views.notes(spark, d).select("note_key", (F.col("start") - first).alias("start"), (F.col("end") - first).alias("end")), 6, "start", "end")


# Scalar measures


@registry.query(
    "musical_measures",
    _sql("""SELECT note_key, round(12 * log2(f0 / 440), 6) AS semitones, round(20 * log10(ampl / 2e-5), 6) AS spl, round(log2(1 + f0_var / f0), 7) AS pitch_variation,
  CASE WHEN ampl_var IS NOT NULL THEN round(greatest(-120, 20 * log10(1 + ampl_var / ampl)), 6) END AS ampl_variation, CAST(round_even(12 * log2(f0 / 440), 0) AS DOUBLE) AS nearest,
  round(((12 * log2(f0 / 440) + 0.5) % 1 + 1) % 1 - 0.5, 6) AS detune FROM n WHERE f0 IS NOT NULL AND ampl IS NOT NULL""", N),
)
def musical_measures(spark: SparkSession, d: str) -> DataFrame:
    n = views.notes(spark, d).filter("f0 IS NOT NULL AND ampl IS NOT NULL")
    x = n.select(
        "note_key",
        exprs.semitones("f0").alias("semitones"),
        exprs.spl_db("ampl").alias("spl"),
        F.log2(1 + F.col("f0_var") / F.col("f0")).alias("pitch_variation"),
        exprs.relative_db("ampl_var", "ampl").alias("ampl_variation"),
        exprs.round_half_even(exprs.semitones("f0")).alias("nearest"),
        exprs.wrap(exprs.semitones("f0"), 1).alias("detune"),
    )
    return rounded(rounded(x, 6, "semitones", "spl", "ampl_variation", "detune"), 7, "pitch_variation")


@registry.query(
    "note_names",
    _sql(f"SELECT note_key, pitch, {_MIDI} AS midi, CAST(round_even(69 + 12 * log2(f0 / 440), 0) AS INT) AS played_midi, ['C', 'C#', 'D', 'D#', 'E', 'F', 'F#', 'G', 'G#', 'A', 'A#', 'B'][CAST(round_even(69 + 12 * log2(f0 / 440), 0) AS INT) % 12 + 1] || CAST(CAST(round_even(69 + 12 * log2(f0 / 440), 0) AS INT) // 12 - 1 AS VARCHAR) AS played FROM (SELECT *, {_PITCH} AS pitch FROM n) WHERE pitch <> '' AND f0 IS NOT NULL", N),
)
def note_names(spark: SparkSession, d: str) -> DataFrame:
    """Written and sounding pitch of notes by name and MIDI number."""
    n = views.notes(spark, d).withColumn("pitch", F.regexp_extract("note_label", r"-\s*([A-G]#?\d)\s*$", 1)).filter("pitch <> '' AND f0 IS NOT NULL")
    x = n.select("note_key", "pitch", exprs.name_to_midi("pitch").alias("midi"), exprs.hz_to_midi("f0").alias("played_midi"))
    return x.withColumn("played", exprs.midi_to_name("played_midi"))


@registry.query(
    "label_parse",
    _sql(r"""SELECT note_key, try_cast(nullif(regexp_extract(note_label, '^\s*(\d+)', 1), '') AS INT) AS number, regexp_extract(tune, '\w+', 0) AS word,
  split_part(file, '/', -1) AS name, split_part(file, '/', -2) AS place, regexp_replace(file, '\.[^./\\]*$', '.TextGrid') AS grid FROM n""", N),
)
def label_parse(spark: SparkSession, d: str) -> DataFrame:
    n = views.notes(spark, d)
    return n.select(
        "note_key",
        exprs.leading_number("note_label").alias("number"),
        exprs.first_word("tune").alias("word"),
        exprs.path_part("file", 1).alias("name"),
        exprs.path_part("file", 2).alias("place"),
        exprs.extension_swapped("file", ".TextGrid").alias("grid"),
    )


@registry.query(
    "beat_warp",
    _sql("""SELECT p.series_id, p.frame_idx, n.note_key, round(n.note_id + (p.t - n."start") / (n."end" - n."start"), 6) AS beat FROM p JOIN n ON n.file = p.file AND p.t >= n."start" AND p.t < n."end" WHERE p.label = 'mouth_dc'""", P, N),
)
def beat_warp(spark: SparkSession, d: str) -> DataFrame:
    """Readings on a clock that counts notes: each note is one unit long."""
    p = views.points(spark, d).filter("label = 'mouth_dc'").select("series_id", "frame_idx", "file", "t")
    n = views.notes(spark, d).select("file", "start", "end", "note_key", "note_id")
    j = intervals.interval_join(p, n, ["file"], closed="left")
    beat = F.col("note_id") + (F.col("t") - F.col("start")) / (F.col("end") - F.col("start"))
    return rounded(j.select("series_id", "frame_idx", "note_key", beat.alias("beat")), 6, "beat")


@registry.query(
    "sounding_bounds",
    _sql("""SELECT note_key, max(t) FILTER (direction = 'up' AND t <= mid) AS onset, min(t) FILTER (direction = 'down' AND t >= mid) AS offset_ FROM (
  SELECT j.note_key, j.t, (j."start" + j."end") / 2 AS mid, CASE WHEN b < thr AND v >= thr THEN 'up' WHEN b >= thr AND v < thr THEN 'down' END AS direction
  FROM (SELECT *, lag(v) OVER (PARTITION BY note_key ORDER BY t, series_id, frame_idx) AS b FROM j) j JOIN c USING (note_key)) GROUP BY note_key""",
         P, N, """j AS (SELECT n.note_key, n."start", n."end", p.series_id, p.frame_idx, p.t, p.v FROM n JOIN p ON p.file = n.file AND p.t BETWEEN n."start" - 0.1 AND n."end" + 0.1 WHERE p.label = 'barrel_ampl')""",
         "c AS (SELECT note_key, sqrt(greatest(min(v), 0) * greatest(quantile_cont(v, 0.99), 0)) AS thr FROM j GROUP BY note_key)"),
)
def sounding_bounds(spark: SparkSession, d: str) -> DataFrame:
    """Where the sound of each note sets in and ends, by its amplitude."""
    p = views.points(spark, d).filter("label = 'barrel_ampl'").select("series_id", "frame_idx", "file", "t", "v")
    n = views.notes(spark, d).select("file", "note_key", "start", "end")
    x = derive.sounding_bounds(p, n, ["file"], "note_key", 0.1)
    return x.withColumnRenamed("offset", "offset_")


@registry.query(
    "coalesce_repeats",
    _sql("""SELECT file, ver_nbr, pitch, run, min(note_id) AS first_note, max(note_id) AS last_note, min("start") AS "start", max("end") AS "end", count(*) AS n_notes FROM (
  SELECT *, CAST(sum(CASE WHEN pitch = b THEN 0 ELSE 1 END) OVER (PARTITION BY file, ver_nbr ORDER BY "start", note_key) AS BIGINT) AS run FROM (
    SELECT *, lag(pitch) OVER (PARTITION BY file, ver_nbr ORDER BY "start", note_key) AS b FROM (SELECT *, """ + _PITCH + """ AS pitch FROM n))) GROUP BY ALL""", N),
)
def coalesce_repeats(spark: SparkSession, d: str) -> DataFrame:
    """Consecutive notes of the same pitch as one."""
    n = views.notes(spark, d).withColumn("pitch", F.regexp_extract("note_label", r"-\s*([A-G]#?\d)\s*$", 1))
    x = derive.runs(n, ["file", "ver_nbr"], ["start", "note_key"], "pitch")
    return x.groupBy("file", "ver_nbr", "pitch", "run").agg(F.min("note_id").alias("first_note"), F.max("note_id").alias("last_note"), F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n_notes"))


@registry.query(
    "corpus_intervals",
    _sql("""SELECT n.file, k.ver_nbr AS clip, round(n."start", 3) AS "start", round(n."end", 3) AS "end", replace(n.note_label, '♯', '#') AS label
FROM n LEFT JOIN k ON k.file = n.file AND (n."start" + n."end") / 2 BETWEEN k."start" AND k."end" """, N, K),
)
def corpus_intervals(spark: SparkSession, d: str) -> DataFrame:
    """Flat list of the notes of all files with the take that holds their middle."""
    n = views.notes(spark, d).select("note_key", "file", "start", "end", "note_label")
    k = _outer(spark, d).join(views.takes(spark, d).select("ver_id", F.col("ver_nbr").alias("clip")), "ver_id")
    x = intervals.midpoint_join(n, k, ["file"], how="left")
    return x.select("file", "clip", F.round("start", 3).alias("start"), F.round("end", 3).alias("end"), exprs.sharps("note_label").alias("label"))


@registry.query(
    "light_note_list",
    _sql("""SELECT x.note_key, count(*) AS n, round(quantile_cont(p.v, 0.5), 8) AS ampl, round(quantile_cont(p.v, 0.75) - quantile_cont(p.v, 0.25), 8) AS ampl_var,
  round((min(p.t) FILTER (p.v = m.hi) - x."start") / (x."end" - x."start"), 6) AS rel_max_t,
  """ + ", ".join(f"round(quantile_cont(p.v, 0.5) FILTER ({_THIRD} = {i}), 8) AS aseg{i - 1}" for i in (1, 2, 3)) + """
FROM n x JOIN p ON p.file = x.file AND p.t BETWEEN x."start" AND x."end" AND p.label = 'barrel_ampl'
JOIN (SELECT y.note_key, max(p.v) AS hi FROM n y JOIN p ON p.file = y.file AND p.t BETWEEN y."start" AND y."end" AND p.label = 'barrel_ampl' GROUP BY ALL) m ON m.note_key = x.note_key
WHERE x."end" > x."start" GROUP BY x.note_key, x."start", x."end" """, P, N),
)
def light_note_list(spark: SparkSession, d: str) -> DataFrame:
    """Level of each note: median and interquartile range, where its maximum lies, medians of its thirds."""
    p = views.points(spark, d).filter("label = 'barrel_ampl'").select("file", "t", "v")
    n = views.notes(spark, d).filter(F.col("end") > F.col("start")).select("note_key", "file", "start", "end")
    j = intervals.interval_join(p, n, ["file"]).withColumn("third", stats.third_of("t", "start", "end"))
    q = F.percentile("v", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    g = j.groupBy("note_key", "start", "end").agg(
        F.count("*").alias("n"), q.alias("q"), (-F.max(F.struct("v", (-F.col("t")).alias("t")))["t"]).alias("max_t"),
        *[F.percentile(F.when(F.col("third") == i, F.col("v")), 0.5).alias(f"aseg{i - 1}") for i in (1, 2, 3)],
    )
    x = g.select("note_key", "n", F.col("q")[1].alias("ampl"), (F.col("q")[2] - F.col("q")[0]).alias("ampl_var"), ((F.col("max_t") - F.col("start")) / (F.col("end") - F.col("start"))).alias("rel_max_t"), "aseg0", "aseg1", "aseg2")
    return rounded(rounded(x, 8, "ampl", "ampl_var", "aseg0", "aseg1", "aseg2"), 6, "rel_max_t")


@registry.query(
    "first_note_of_take",
    _sql('SELECT file, ver_nbr, note_key, pitch FROM (SELECT file, ver_nbr, note_key, nullif(' + _PITCH + ", '') AS pitch, row_number() OVER (PARTITION BY file, ver_nbr ORDER BY \"start\", note_key) AS i FROM n) WHERE i = 1", N),
)
def first_note_of_take(spark: SparkSession, d: str) -> DataFrame:
    n = views.notes(spark, d).withColumn("pitch", F.nullif(F.regexp_extract("note_label", r"-\s*([A-G]#?\d)\s*$", 1), F.lit("")))
    g = n.groupBy("file", "ver_nbr").agg(F.min(F.struct("start", "note_key", "pitch")).alias("m"))
    return g.select("file", "ver_nbr", "m.note_key", "m.pitch")


@registry.query(
    "tongue_events",
    _sql("""SELECT q.note_key, e.t AS release_t, round(q."start" - e.t, 6) AS lead FROM n q ASOF JOIN e ON e.file = q.file AND e.t <= q."start" WHERE q."start" - e.t <= 0.5""",
         P, N, """e AS (SELECT file, t FROM (SELECT file, t, v, lag(v) OVER (PARTITION BY series_id ORDER BY frame_idx) AS b FROM p WHERE label = 'tongue_contact') WHERE b = 1 AND v = 0 GROUP BY ALL)"""),
)
def tongue_events(spark: SparkSession, d: str) -> DataFrame:
    """The last release of the tongue in the half second before each note."""
    p = views.points(spark, d).filter("label = 'tongue_contact'").select("series_id", "frame_idx", "file", "t", "v")
    x = windows.before(p, ["series_id"], ["frame_idx"], "v", "before")
    e = x.filter("before = 1 AND v = 0").select("file", F.col("t").alias("mark_t"), F.lit(0).alias("event")).distinct()
    n = views.notes(spark, d).select("note_key", "file", F.col("start").alias("t"))
    j = intervals.asof(n, e, ["file"], ["event"])
    lead = F.col("t") - F.col("mark_t")
    return rounded(j.filter(lead <= 0.5).select("note_key", F.col("mark_t").alias("release_t"), lead.alias("lead")), 6, "lead")


@registry.query(
    "frame_table",
    _sql("""SELECT f.series_id, f.frame_idx, f.t, f.v AS f0, CAST(round_even(69 + 12 * log2(f.v / 440), 0) AS INT) AS midi, max_by(n.note_id, (n."start", n.note_key)) AS note_id
FROM p f LEFT JOIN n ON n.file = f.file AND f.t BETWEEN n."start" AND n."end" WHERE f.label = 'external_f0' AND f.v > 0 GROUP BY ALL""", P, N),
)
def frame_table(spark: SparkSession, d: str) -> DataFrame:
    """Frames of the external microphone's frequency with MIDI number and note."""
    p = views.points(spark, d).filter("label = 'external_f0' AND v > 0").select("series_id", "frame_idx", "file", "t", "v")
    n = views.notes(spark, d).select("file", "start", "end", F.struct("start", "note_key").alias("place"), "note_id")
    x = intervals.last_wins(p, n, ["file"], ["series_id", "frame_idx", "t", "v"], "place", ["note_id"])
    return x.select("series_id", "frame_idx", "t", F.col("v").alias("f0"), exprs.hz_to_midi("v").alias("midi"), "note_id")
