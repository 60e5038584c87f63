"""Queries on series of readings."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ostinato.functions import exprs
from ostinato.operators import blocks, intervals, stats, windows
from ostinato.plans import views
from ostinato.plans.registry import Registry
from ostinato.plans.views import P, R, rounded
from ostinato.session import present, table
from ostinato.sources.channels import CHANNELS, base_channel, calibrated

registry = Registry()
_AMPL = "r.label LIKE '%\\_ampl' ESCAPE '\\'"


def _ampl(spark: SparkSession, d: str) -> DataFrame:
    return views.readings(spark, d).filter(F.col("label").endswith("_ampl"))


def _sql(text: str, *ctes: str) -> str:
    return "WITH " + ", ".join(ctes) + "\n" + text


_DIM = "dim AS (SELECT * FROM (VALUES " + ", ".join(f"('{n}', {g}::DOUBLE, {o}::DOUBLE, {str(k).upper()})" for n, g, o, k in CHANNELS) + ") AS x(channel, gain, \"offset\", keep))"


@registry.query(
    "calibrate_channels",
    _sql('SELECT series_id, frame_idx, label, round((v + coalesce("offset", 0)) * coalesce(gain, 1), 6) AS value FROM r LEFT JOIN dim ON dim.channel = split_part(r.label, \'_\', 1) WHERE coalesce(keep, TRUE)', R, _DIM),
)
def calibrate_channels(spark: SparkSession, d: str) -> DataFrame:
    r = views.readings(spark, d).withColumn("channel", F.split_part("label", F.lit("_"), F.lit(1)))
    return rounded(calibrated(r, "channel", "v").select("series_id", "frame_idx", "label", "value"), 6, "value")


@registry.query(
    "base_channel_priority",
    """
WITH c AS (SELECT DISTINCT rec_id, split_part(label, '_', 1) AS channel FROM series),
p AS (SELECT rec_id, min(CASE channel WHEN 'barrel' THEN 1 WHEN 'external' THEN 2 WHEN 'farfield' THEN 3 END) AS place FROM c GROUP BY rec_id)
SELECT rec_id, CASE coalesce(place, 3) WHEN 1 THEN 'barrel' WHEN 2 THEN 'external' ELSE 'farfield' END AS channel FROM p
""",
)
def base_channel_priority(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "series").select("rec_id", F.split_part("label", F.lit("_"), F.lit(1)).alias("channel"))
    return base_channel(s, ["rec_id"])


@registry.query(
    "channel_percentiles",
    _sql("SELECT series_id, label, " + ", ".join(f"round(quantile_cont(v, {p}), 8) AS p{round(100 * p):02d}" for p in (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)) + " FROM r GROUP BY ALL", R),
)
def channel_percentiles(spark: SparkSession, d: str) -> DataFrame:
    at = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)
    x = stats.percentiles(views.readings(spark, d), ["series_id", "label"], "v", at)
    return rounded(x, 8, *[f"p{round(100 * p):02d}" for p in at])


_LEVELS = """e AS (SELECT series_id, sqrt(greatest(quantile_cont(v, 0.01), 0) * greatest(quantile_cont(v, 0.99), 0)) AS threshold FROM r WHERE r.label LIKE '%ampl' GROUP BY series_id)"""


@registry.query(
    "silence_voice_levels",
    _sql("SELECT r.series_id, round(threshold, 6) AS threshold, round(quantile_cont(v, 0.5) FILTER (v <= threshold), 8) AS silence, round(quantile_cont(v, 0.5) FILTER (v > threshold), 8) AS voice FROM r JOIN e USING (series_id) GROUP BY ALL", R, _LEVELS),
)
def silence_voice_levels(spark: SparkSession, d: str) -> DataFrame:
    x = stats.silence_voice(_ampl(spark, d), ["series_id"], "v")
    return rounded(rounded(x, 6, "threshold"), 8, "silence", "voice")


_EDGES = """edges AS (
  SELECT series_id, frame_idx, t, v, CASE WHEN b < threshold AND v >= threshold THEN 'up' WHEN b >= threshold AND v < threshold THEN 'down' END AS direction
  FROM (SELECT r.*, threshold, lag(v) OVER (PARTITION BY series_id ORDER BY t, frame_idx) AS b FROM r JOIN e USING (series_id))
)"""


@registry.query("threshold_crossings", _sql("SELECT series_id, frame_idx, t, direction FROM edges WHERE direction IS NOT NULL", R, _LEVELS, _EDGES))
def threshold_crossings(spark: SparkSession, d: str) -> DataFrame:
    return _crossings(spark, d).select("series_id", "frame_idx", "t", "direction")


def _crossings(spark: SparkSession, d: str) -> DataFrame:
    r = _ampl(spark, d)
    levels = stats.silence_voice(r, ["series_id"], "v").select("series_id", "threshold")
    return windows.crossings(r.join(levels, "series_id"), ["series_id"], ["t", "frame_idx"], "v", "threshold", blocks.SECONDS)


@registry.query(
    "silence_report",
    _sql("""
SELECT a.series_id, a.n_frames, a.n_silent, a.first_t, a.last_t, x.n_up, x.first_up, x.last_down
FROM (SELECT r.series_id, count(*) AS n_frames, count(*) FILTER (v < threshold) AS n_silent, min(t) AS first_t, max(t) AS last_t FROM r JOIN e USING (series_id) GROUP BY ALL) a
LEFT JOIN (SELECT series_id, count(*) FILTER (direction = 'up') AS n_up, min(t) FILTER (direction = 'up') AS first_up, max(t) FILTER (direction = 'down') AS last_down FROM edges WHERE direction IS NOT NULL GROUP BY ALL) x USING (series_id)
""", R, _LEVELS, _EDGES),
)
def silence_report(spark: SparkSession, d: str) -> DataFrame:
    r = _ampl(spark, d)
    levels = stats.silence_voice(r, ["series_id"], "v").select("series_id", "threshold")
    x = windows.before(r.join(levels, "series_id"), ["series_id"], ["t", "frame_idx"], "v", "before", blocks.SECONDS)
    up = (F.col("before") < F.col("threshold")) & (F.col("v") >= F.col("threshold"))
    down = (F.col("before") >= F.col("threshold")) & (F.col("v") < F.col("threshold"))
    g = x.groupBy("series_id").agg(
        F.count("*").alias("n_frames"),
        F.count_if(F.col("v") < F.col("threshold")).alias("n_silent"),
        F.min("t").alias("first_t"),
        F.max("t").alias("last_t"),
        F.count_if(up).alias("__up"),
        F.count_if(up | down).alias("__any"),
        F.min(F.when(up, F.col("t"))).alias("first_up"),
        F.max(F.when(down, F.col("t"))).alias("last_down"),
    )
    return g.withColumn("n_up", F.when(F.col("__any") > 0, F.col("__up"))).drop("__up", "__any")


_TURN = "12 * log2(v / 440)"


@registry.query(
    "reference_pitch",
    _sql(f"SELECT series_id, round(atan2(avg(sin(2 * pi() * {_TURN})), avg(cos(2 * pi() * {_TURN}))) / (2 * pi()), 6) AS pitch FROM r WHERE r.label LIKE '%f0' AND v > 0 GROUP BY series_id", R),
)
def reference_pitch(spark: SparkSession, d: str) -> DataFrame:
    r = views.readings(spark, d).filter(F.col("label").endswith("_f0") & (F.col("v") > 0))
    turn = exprs.semitones("v") * (2 * math.pi)
    return rounded(r.groupBy("series_id").agg((exprs.circular_mean(turn) / (2 * math.pi)).alias("pitch")), 6, "pitch")


_QUANTILES = (0.05, 0.25, 0.5, 0.75, 0.95)


def _weighted(source: str, keys: str) -> str:
    q = ", ".join(
        f"round(max(CASE WHEN pos <= {p} AND p2 > {p} THEN v + (v2 - v) * ({p} - pos) / nullif(p2 - pos, 0) WHEN (i = 1 AND pos > {p}) OR (p2 IS NULL AND pos <= {p}) THEN v END), 6) AS q{round(100 * p):02d}"
        for p in _QUANTILES
    )
    return f"""a AS (SELECT *, (sum(weight) OVER (PARTITION BY {keys} ORDER BY v, frame_idx ROWS UNBOUNDED PRECEDING) - weight / 2) / sum(weight) OVER (PARTITION BY {keys}) AS pos FROM {source}),
b AS (SELECT {keys}, v, pos, lead(v) OVER w AS v2, lead(pos) OVER w AS p2, row_number() OVER w AS i FROM a WINDOW w AS (PARTITION BY {keys} ORDER BY v, frame_idx))
SELECT {keys}, {q} FROM b GROUP BY {keys}"""


@registry.query("weighted_quantiles", "WITH " + R + ", x AS (SELECT series_id, frame_idx, v, CAST(1 + frame_idx % 4 AS DOUBLE) AS weight FROM r), " + _weighted("x", "series_id"))
def weighted_quantiles(spark: SparkSession, d: str) -> DataFrame:
    r = views.readings(spark, d).withColumn("weight", (1 + F.col("frame_idx") % 4).cast("double"))
    x = stats.weighted_quantiles(r, ["series_id"], "v", "weight", _QUANTILES, "frame_idx")
    return rounded(x, 6, *[f"q{round(100 * p):02d}" for p in _QUANTILES])


_WINDOW, _HOP = 16, 8
_FRAMED = f"""i AS (SELECT series_id, frame_idx, label, v, row_number() OVER (PARTITION BY series_id ORDER BY frame_idx) - 1 AS pos FROM r),
f AS (SELECT series_id, frame_idx, v, k AS frame, pos - k * {_HOP} AS place FROM i, unnest([pos // {_HOP}, pos // {_HOP} - 1]) AS u(k) WHERE k >= 0 AND pos - k * {_HOP} < {_WINDOW}),
g AS (SELECT *, count(*) OVER (PARTITION BY series_id, frame) AS held FROM f)"""


def _framed(r: DataFrame) -> DataFrame:
    """Rows of a series in frames of _WINDOW rows every _HOP rows: frame, place within it; only full frames."""
    pos = blocks.tidy(blocks.numbered(r, ["series_id"], ["frame_idx"], blocks.ROWS))
    own = F.floor(F.col("pos") / _HOP)
    f = pos.withColumn("frame", F.explode(F.sequence(F.greatest(own - (_WINDOW // _HOP - 1), F.lit(0)), own)))
    f = f.withColumn("place", F.col("pos") - F.col("frame") * _HOP)
    w = windows.Window.partitionBy("series_id", "frame")
    return f.withColumn("held", F.count("*").over(w)).filter(F.col("held") == _WINDOW)


@registry.query(
    "windowed_weighted_quantiles",
    "WITH " + R + ", " + _FRAMED + f", x AS (SELECT series_id, frame, frame_idx, v, round(0.5 - 0.5 * cos(2 * pi() * (place + 1) / {_WINDOW + 1}), 6) AS weight FROM g WHERE held = {_WINDOW}), " + _weighted("x", "series_id, frame"),
)
def windowed_weighted_quantiles(spark: SparkSession, d: str) -> DataFrame:
    weight = F.round(0.5 - 0.5 * F.cos(2 * math.pi * (F.col("place") + 1) / (_WINDOW + 1)), 6)
    f = _framed(views.readings(spark, d)).withColumn("weight", weight)
    x = stats.weighted_quantiles(f, ["series_id", "frame"], "v", "weight", _QUANTILES, "frame_idx")
    return rounded(x, 6, *[f"q{round(100 * p):02d}" for p in _QUANTILES])


@registry.query(
    "rms_envelope",
    "WITH " + R + ", " + _FRAMED + f""",
x AS (SELECT series_id, frame, v - avg(v) OVER (PARTITION BY series_id, frame) AS y, 0.42 - 0.5 * cos(2 * pi() * place / {_WINDOW - 1}) + 0.08 * cos(4 * pi() * place / {_WINDOW - 1}) AS weight FROM g WHERE held = {_WINDOW})
SELECT series_id, frame, round(sqrt(sum(y * weight * y * weight) / sum(weight * weight)), 5) AS rms FROM x GROUP BY ALL""",
)
def rms_envelope(spark: SparkSession, d: str) -> DataFrame:
    f = _framed(views.readings(spark, d))
    w = windows.Window.partitionBy("series_id", "frame")
    turn = 2 * math.pi * F.col("place") / (_WINDOW - 1)
    f = f.withColumn("y", (F.col("v") - F.avg("v").over(w))).withColumn("weight", 0.42 - 0.5 * F.cos(turn) + 0.08 * F.cos(2 * turn))
    yw = F.col("y") * F.col("weight")
    x = f.groupBy("series_id", "frame").agg(F.sqrt(F.sum(yw * yw) / F.sum(F.col("weight") * F.col("weight"))).alias("rms"))
    return rounded(x, 5, "rms")


def _normalised(mode: str, middle: str, spread: str, registry: Registry = registry):
    sql = _sql(f"SELECT series_id, frame_idx, round((v - a) / nullif(b, 0), 6) AS normal FROM r JOIN s USING (series_id)", R, f"s AS (SELECT series_id, {middle} AS a, {spread} AS b FROM r GROUP BY series_id)")

    @registry.query(f"normalize_{mode}", sql)
    def run(spark: SparkSession, d: str) -> DataFrame:
        x = stats.normalised(views.readings(spark, d), ["series_id"], "v", mode)
        return rounded(x.select("series_id", "frame_idx", "normal"), 6, "normal")

    return run


_normalised("std", "CAST(sum(CAST(v AS DECIMAL(28, 6))) AS DOUBLE) / count(v)", "stddev_pop(v)")
_normalised("iqr", "quantile_cont(v, 0.5)", "quantile_cont(v, 0.75) - quantile_cont(v, 0.25)")
_normalised("minmax", "min(v)", "max(v) - min(v)")


@registry.query(
    "islands_min_gap",
    _sql("""
SELECT series_id, island, min_by(frame_idx, i) AS first_frame_idx, max_by(frame_idx, i) AS last_frame_idx, count(*) AS n_active
FROM (SELECT *, CAST(sum(CASE WHEN i - b > 3 OR b IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY series_id ORDER BY i) AS BIGINT) AS island
  FROM (SELECT *, lag(i) OVER (PARTITION BY series_id ORDER BY i) AS b FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY frame_idx) AS i FROM r WHERE r.label = 'mouth_dc') WHERE v > 1))
GROUP BY ALL""", R),
)
def islands_min_gap(spark: SparkSession, d: str) -> DataFrame:
    r = views.readings(spark, d).filter("label = 'mouth_dc'")
    return windows.islands(r, ["series_id"], ["frame_idx"], F.col("v") > 1, min_gap=3)


@registry.query(
    "phrase_silence_spans",
    _sql("""
SELECT series_id, t AS "start", coalesce(nxt, last) AS "end", round(threshold, 6) AS threshold FROM (
  SELECT *, lead(t) OVER (PARTITION BY series_id ORDER BY t) AS nxt FROM (
    SELECT *, CASE WHEN is_on AND NOT was THEN 'on' WHEN NOT is_on AND was THEN 'off' END AS edge FROM (
      SELECT *, coalesce(lag(is_on) OVER (PARTITION BY series_id ORDER BY t), FALSE) AS was FROM (
        SELECT q.*, threshold, last, q.v >= threshold AS is_on FROM q JOIN s USING (series_id))))
  WHERE edge IS NOT NULL) WHERE edge = 'on'""",
    R, "q AS (SELECT series_id, t, max(v) AS v FROM r WHERE r.label = 'mouth_dc' GROUP BY ALL)", "s AS (SELECT series_id, quantile_cont(v, 0.99) * 0.2 AS threshold, max(t) AS last FROM q GROUP BY series_id)"),
)
def phrase_silence_spans(spark: SparkSession, d: str) -> DataFrame:
    r = views.readings(spark, d).filter("label = 'mouth_dc'").groupBy("series_id", "t").agg(F.max("v").alias("v"))
    return rounded(windows.phrases(r, ["series_id"], "t", "v", 0.2), 6, "threshold")


@registry.query(
    "median_filter",
    _sql("SELECT series_id, frame_idx, list_sort(list_concat(list(v) OVER w, list_resize(CAST([] AS DOUBLE[]), 5 - count(*) OVER w, 0.0)))[3] AS smooth FROM r WHERE r.label LIKE '%f0' WINDOW w AS (PARTITION BY series_id ORDER BY frame_idx ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)", R),
)
def median_filter(spark: SparkSession, d: str) -> DataFrame:
    r = views.readings(spark, d).filter(F.col("label").endswith("_f0"))
    return windows.median_filter(r, ["series_id"], ["frame_idx"], "v", 2, "smooth").select("series_id", "frame_idx", "smooth")


@registry.query("change_points", _sql("SELECT * FROM (SELECT series_id, frame_idx, v, lead(v) OVER (PARTITION BY series_id ORDER BY frame_idx) AS next FROM r WHERE r.label = 'tongue_contact') WHERE next <> v", R))
def change_points(spark: SparkSession, d: str) -> DataFrame:
    r = views.readings(spark, d).filter("label = 'tongue_contact'").select("series_id", "frame_idx", "v")
    return windows.change_points(r, ["series_id"], ["frame_idx"], "v")


@registry.query(
    "rolling_std",
    _sql("SELECT series_id, frame_idx, CASE WHEN count(*) OVER w = 9 THEN round(stddev_pop(v) OVER w, 5) ELSE 0 END AS spread FROM r WINDOW w AS (PARTITION BY series_id ORDER BY frame_idx ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING)", R),
)
def rolling_std(spark: SparkSession, d: str) -> DataFrame:
    x = windows.rolling(views.readings(spark, d), ["series_id"], ["frame_idx"], "v", 4, F.stddev_pop, "spread")
    return rounded(x.select("series_id", "frame_idx", "spread"), 5, "spread")


@registry.query(
    "local_maxima",
    _sql("SELECT series_id, frame_idx, v FROM (SELECT *, max(v) OVER (w ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING) AS a, max(v) OVER (w ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING) AS b FROM r WHERE r.label LIKE '%ampl' WINDOW w AS (PARTITION BY series_id ORDER BY frame_idx)) WHERE v > a AND v > b", R),
)
def local_maxima(spark: SparkSession, d: str) -> DataFrame:
    return windows.local_maxima(_ampl(spark, d), ["series_id"], ["frame_idx"], "v", 2).select("series_id", "frame_idx", "v")


@registry.query(
    "running_max_threshold",
    _sql("SELECT r.series_id, r.frame_idx, r.v, round(threshold, 8) AS threshold FROM r JOIN (SELECT series_id, max(p) AS threshold FROM (SELECT series_id, floor(t) AS block, quantile_cont(v, 0.99) AS p FROM r WHERE r.label LIKE '%ampl' GROUP BY ALL) GROUP BY series_id) s USING (series_id) WHERE r.label LIKE '%ampl' AND v >= threshold", R),
)
def running_max_threshold(spark: SparkSession, d: str) -> DataFrame:
    r = _ampl(spark, d).withColumn("block", F.floor("t"))
    return rounded(windows.above_running_maximum(r, ["series_id"], "block", "v").select("series_id", "frame_idx", "v", "threshold"), 8, "threshold")


@registry.query(
    "forward_fill_forget",
    """
WITH x AS (SELECT DISTINCT series_id, frame_idx, t, CASE WHEN NOT isnan(v) THEN v END AS v FROM readings WHERE t IS NOT NULL AND NOT isnan(t)),
y AS (SELECT *, last_value(CASE WHEN v IS NOT NULL THEN {'v': v, 't': t} END IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY t, frame_idx ROWS UNBOUNDED PRECEDING) AS s FROM x)
SELECT series_id, frame_idx, CASE WHEN t - s.t <= 0.05 THEN s.v END AS v FROM y
""",
)
def forward_fill_forget(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "readings").select("series_id", "frame_idx", "t", exprs.clean("v").alias("v")).filter(present("t")).dropDuplicates(["series_id", "frame_idx"])
    return windows.forget_fill(x, ["series_id"], ["t", "frame_idx"], "v", 0.05, "filled").select("series_id", "frame_idx", F.col("filled").alias("v"))


@registry.query(
    "top_peaks",
    _sql("SELECT series_id, frame_idx, v, place FROM (SELECT series_id, frame_idx, v, row_number() OVER (PARTITION BY series_id ORDER BY v DESC, frame_idx) AS place FROM (SELECT *, max(v) OVER (w ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING) AS a, max(v) OVER (w ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING) AS b FROM r WHERE r.label LIKE '%ampl' WINDOW w AS (PARTITION BY series_id ORDER BY frame_idx)) WHERE v > a AND v > b) WHERE place <= 5", R),
)
def top_peaks(spark: SparkSession, d: str) -> DataFrame:
    """The five highest peaks of each series: a top-n report."""
    x = windows.local_maxima(_ampl(spark, d), ["series_id"], ["frame_idx"], "v", 2)
    # The best five of each part first, then the best five of those.
    x = blocks.parted(x, "frame_idx", blocks.ROWS)
    for keys in (["series_id", blocks.PART], ["series_id"]):
        x = x.withColumn("place", F.row_number().over(windows.ordered(keys, F.desc("v"), "frame_idx")).cast("long")).filter("place <= 5")
    return x.select("series_id", "frame_idx", "v", "place")


_PAIR = """a AS (SELECT rec_id, t FROM p WHERE label = 'barrel_f0' GROUP BY ALL),
b AS (SELECT rec_id, t AS mark_t, min(v) AS value FROM p WHERE label = 'barrel_ampl' GROUP BY ALL)"""
_LERP = """l AS (
  SELECT a.rec_id, a.t, lo.mark_t AS t1, lo.value AS v1, hi.mark_t AS t2, hi.value AS v2
  FROM a ASOF LEFT JOIN b lo ON a.rec_id = lo.rec_id AND a.t >= lo.mark_t
  ASOF LEFT JOIN b hi ON a.rec_id = hi.rec_id AND a.t <= hi.mark_t
), w AS (SELECT rec_id, t, t1, t2, CASE WHEN t1 = t THEN v1 ELSE coalesce(v1 + (v2 - v1) * ((t - t1) / nullif(t2 - t1, 0)), v1, v2) END AS value FROM l)"""


def _pair(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    p = views.points(spark, d)
    a = p.filter("label = 'barrel_f0'").select("rec_id", "t").distinct()
    b = p.filter("label = 'barrel_ampl'").groupBy("rec_id", F.col("t").alias("mark_t")).agg(F.min("v").alias("value"))
    return a, b


@registry.query("lerp_resample", _sql("SELECT rec_id, t, round(value, 6) AS value FROM w", P, _PAIR, _LERP))
def lerp_resample(spark: SparkSession, d: str) -> DataFrame:
    a, b = _pair(spark, d)
    return rounded(intervals.lerp(a, b, ["rec_id"]), 6, "value")


@registry.query(
    "series_difference",
    _sql("SELECT x.rec_id, x.t, round(w.value - x.v, 5) AS difference FROM x JOIN w ON w.rec_id = x.rec_id AND w.t = x.t WHERE w.t1 IS NOT NULL AND w.t2 IS NOT NULL", P,
         "x AS (SELECT rec_id, t, min(v) AS v FROM p WHERE label = 'external_ampl' GROUP BY ALL)", "a AS (SELECT rec_id, t FROM x)", _PAIR.split(",\n")[1], _LERP),
)
def series_difference(spark: SparkSession, d: str) -> DataFrame:
    """barrel_ampl on the clock of external_ampl, less it, where both have readings."""
    p = views.points(spark, d)
    x = p.filter("label = 'external_ampl'").groupBy("rec_id", "t").agg(F.min("v").alias("v"))
    b = p.filter("label = 'barrel_ampl'").groupBy("rec_id", F.col("t").alias("mark_t")).agg(F.min("v").alias("value"))
    span = b.groupBy("rec_id").agg(F.min("mark_t").alias("t1"), F.max("mark_t").alias("t2"))
    w = intervals.lerp(x, b, ["rec_id"]).join(span, "rec_id").filter("t >= t1 AND t <= t2")
    return rounded(w.select("rec_id", "t", (F.col("value") - F.col("v")).alias("difference")), 5, "difference")


@registry.query(
    "coalesce_channels",
    _sql("SELECT rec_id, round(coalesce(b, f, e), 8) AS f0, CASE WHEN b IS NOT NULL THEN 'barrel' WHEN f IS NOT NULL THEN 'farfield' WHEN e IS NOT NULL THEN 'external' END AS channel FROM (SELECT rec_id, quantile_cont(v, 0.5) FILTER (label = 'barrel_f0') AS b, quantile_cont(v, 0.5) FILTER (label = 'farfield_f0') AS f, quantile_cont(v, 0.5) FILTER (label = 'external_f0') AS e FROM p GROUP BY rec_id)", P),
)
def coalesce_channels(spark: SparkSession, d: str) -> DataFrame:
    """Median frequency of each recording from the first channel that has one."""
    p = views.points(spark, d)
    channels = ["barrel", "farfield", "external"]
    g = p.groupBy("rec_id").agg(*[F.percentile(F.when(F.col("label") == f"{c}_f0", F.col("v")), 0.5).alias(c) for c in channels])
    which = F.coalesce(*[F.when(F.col(c).isNotNull(), F.lit(c)) for c in channels])
    return rounded(g.select("rec_id", F.coalesce(*channels).alias("f0"), which.alias("channel")), 8, "f0")


@registry.query(
    "series_pivot",
    _sql("SELECT rec_id, CAST(floor(t) AS BIGINT) AS second, round(max(v) FILTER (label = 'barrel_f0'), 6) AS barrel_f0, round(max(v) FILTER (label = 'barrel_ampl'), 6) AS barrel_ampl, round(max(v) FILTER (label = 'mouth_dc'), 6) AS mouth_dc FROM p WHERE label IN ('barrel_f0', 'barrel_ampl', 'mouth_dc') GROUP BY ALL", P),
)
def series_pivot(spark: SparkSession, d: str) -> DataFrame:
    """Frame table: one row for each second of a recording, one column for each label."""
    labels = ["barrel_f0", "barrel_ampl", "mouth_dc"]
    p = views.points(spark, d).filter(F.col("label").isin(labels)).withColumn("second", F.floor("t"))
    return rounded(p.groupBy("rec_id", "second").pivot("label", labels).agg(F.max("v")), 6, *labels)
