"""Cleaned views of the tables that queries start from, in Spark and as common table expressions.

Copies that differ only in loaded_at count once; NaN and stand-ins are null; paths are keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ostinato.functions.exprs import SPAN, clean
from ostinato.operators.hotdeck import INSTRUMENTS, NOTE_LIMITS, category_or_null, number_or_null
from ostinato.session import broadcast_if_small, path_key, present, table

_PATH = r"replace(lower(regexp_replace({}, '\s', '', 'g')), '\', '/')"


def path_sql(c: str) -> str:
    return _PATH.format(c)


def readings(spark: SparkSession, d: str) -> DataFrame:
    """series_id, frame_idx, label, t, v; both t and v are there."""
    return table(spark, d, "readings").select("series_id", "frame_idx", "label", "t", "v").filter(present("t") & present("v")).dropDuplicates(["series_id", "frame_idx"])


R = """r AS (
  SELECT DISTINCT series_id, frame_idx, label, t, v FROM readings
  WHERE t IS NOT NULL AND NOT isnan(t) AND v IS NOT NULL AND NOT isnan(v)
)"""


def headers(spark: SparkSession, d: str) -> DataFrame:
    """series_id, rec_id, label, file of each series."""
    rec = table(spark, d, "recordings").select("rec_id", path_key("filename").alias("file"))
    return table(spark, d, "series").select("series_id", "rec_id", "label").join(broadcast_if_small(rec), "rec_id")


H = f"h AS (SELECT s.series_id, s.rec_id, s.label, {path_sql('c.filename')} AS file FROM series s JOIN recordings c USING (rec_id))"


def points(spark: SparkSession, d: str) -> DataFrame:
    """Readings with their recording: series_id, frame_idx, label, t, v, rec_id, file."""
    return readings(spark, d).join(broadcast_if_small(headers(spark, d).drop("label")), "series_id")


P = R + ", " + H + ", p AS (SELECT r.*, h.rec_id, h.file FROM r JOIN h USING (series_id))"


def notes(spark: SparkSession, d: str) -> DataFrame:
    """Notes that have a start and an end."""
    f0, ampl = (number_or_null(c, *NOTE_LIMITS[c]) for c in ("f0_avg", "ext_ampl_avg"))
    return (
        table(spark, d, "notes")
        .filter(present("note_start") & present("note_end"))
        .select(
            "note_key", path_key("wavfile").alias("file"), "ver_nbr", "note_id", "note_label", "tune", "subject_id",
            category_or_null("instrument", INSTRUMENTS).alias("instrument"),
            F.col("note_start").alias("start"), F.col("note_end").alias("end"), "sound_start", "sound_end",
            f0.alias("f0"), clean("f0_var").alias("f0_var"), ampl.alias("ampl"), clean("ext_ampl_var").alias("ampl_var"),
        )
        .dropDuplicates(["note_key"])
    )


N = f"""n AS (
  SELECT DISTINCT note_key, {path_sql('wavfile')} AS file, ver_nbr, note_id, note_label, tune, subject_id,
    CASE WHEN lower(trim(instrument)) IN ('lab', 'own') THEN lower(trim(instrument)) END AS instrument,
    note_start AS "start", note_end AS "end", sound_start, sound_end,
    CASE WHEN NOT isnan(f0_avg) AND f0_avg > 59.999 AND f0_avg <= 1600 THEN f0_avg END AS f0, CASE WHEN NOT isnan(f0_var) THEN f0_var END AS f0_var,
    CASE WHEN NOT isnan(ext_ampl_avg) AND ext_ampl_avg > 0 AND ext_ampl_avg <= 120 THEN ext_ampl_avg END AS ampl, CASE WHEN NOT isnan(ext_ampl_var) THEN ext_ampl_var END AS ampl_var
  FROM notes WHERE note_start IS NOT NULL AND NOT isnan(note_start) AND note_end IS NOT NULL AND NOT isnan(note_end)
)"""


def takes(spark: SparkSession, d: str) -> DataFrame:
    """Versions: ver_id, file, ver_nbr, tune, instrument, subject_id, start, end."""
    return table(spark, d, "versions").select(
        "ver_id", path_key("wavfile").alias("file"), "ver_nbr", "tune", "instrument", "subject_id", F.col("vers_start").alias("start"), F.col("vers_end").alias("end")
    )


K = f"""k AS (
  SELECT ver_id, {path_sql('wavfile')} AS file, ver_nbr, tune, instrument, subject_id, vers_start AS "start", vers_end AS "end" FROM versions
)"""


def marks(spark: SparkSession, d: str) -> DataFrame:
    """Video marks once each: mark_id, video, msec, marker_id, x, y, w, h, source, template_val."""
    b = F.col("bbox")
    return (
        table(spark, d, "video_marks")
        .select("mark_id", path_key("video_file").alias("video"), "msec", "marker_id", b[0].alias("x"), b[1].alias("y"), b[2].alias("w"), b[3].alias("h"), "source", clean("template_val").alias("template_val"))
        .dropDuplicates(["mark_id"])
    )


M = f"""m AS (
  SELECT DISTINCT mark_id, {path_sql('video_file')} AS video, msec, marker_id, bbox[1] AS x, bbox[2] AS y, bbox[3] AS w, bbox[4] AS h, source,
    CASE WHEN NOT isnan(template_val) THEN template_val END AS template_val
  FROM video_marks
)"""


_TYPED = "translate(lower(trim(regexp_replace(video_to_signal_delay, '\\s+', ' ', 'g'))), ',−', '.-')"
#: The best usable delay of each pair of files, however it was typed.
B = f"""b AS (
  SELECT video, signal, CASE WHEN unit LIKE 'ms%' OR unit LIKE 'milli%' THEN number / 1000 WHEN unit = 'min' THEN number * 60 ELSE number END AS delay
  FROM (SELECT {path_sql('video_file')} AS video, {path_sql('signal_file')} AS signal, CASE WHEN isnan(frac) THEN -1 ELSE coalesce(frac, -1) END AS frac,
    try_cast(replace(regexp_extract({_TYPED}, '{SPAN}', 1), ' ', '') AS DOUBLE) AS number, regexp_extract({_TYPED}, '{SPAN}', 2) AS unit FROM wav_video_delays)
  WHERE number IS NOT NULL QUALIFY row_number() OVER (PARTITION BY video, signal ORDER BY frac DESC, delay) = 1
)"""


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def settled(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    """Columns rounded by way of decimals, so that values half-way between two come out the same whatever their last bits; as settled_sql."""
    return df.withColumns({c: F.round(F.col(c).cast("decimal(28,8)"), digits).cast("double") for c in columns})


def settled_sql(x: str, digits: int) -> str:
    return f"CAST(round(CAST({x} AS DECIMAL(28, 8)), {digits}) AS DOUBLE)"
