"""Queries of the problems on text and matching: p3, p5 to p9."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ostinato.llm import cutting, names, nearest, packing, splits, tokens
from ostinato.plans.registry import Registry
from ostinato.session import table

registry = Registry()


@registry.query("p3_found")
def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions whose name means an entry of expressions."""
    return p3_mapped(spark, sf_dir).filter("expr_id IS NOT NULL").select("ver_id", "expr_id")


@registry.query("p3_mapped")
def p3_mapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every version with the entry its name means; null where it means none."""
    return names.map_names(table(spark, sf_dir, "versions"), "ver_id", "ver_name", table(spark, sf_dir, "expressions"), "expr_id", "expr_name")


@registry.query("p5_splits")
def p5_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Split of each recording."""
    return splits.split_recordings(table(spark, sf_dir, "recordings"))


@registry.query("p5_balance")
def p5_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each split by tune and instrument."""
    r = table(spark, sf_dir, "recordings").select("rec_id", "tune", "instrument")
    return p5_splits(spark, sf_dir).join(r, "rec_id").groupBy("split", "tune", "instrument").agg(F.count("*").alias("n"))


_DELAY = r"""
WITH typed AS (
  SELECT replace(lower(regexp_replace(video_file, '\s', '', 'g')), '\', '/') AS video,
         replace(lower(regexp_replace(signal_file, '\s', '', 'g')), '\', '/') AS signal,
         replace(lower(trim(video_to_signal_delay)), ',', '.') AS d, frac
  FROM wav_video_delays
), usable AS (
  SELECT video, signal, frac,
    CASE WHEN d LIKE '%ms' THEN try_cast(trim(replace(d, 'ms', '')) AS DOUBLE) / 1000 ELSE try_cast(trim(rtrim(d, 's')) AS DOUBLE) END AS delay
  FROM typed
), best AS (
  SELECT video, signal, delay FROM usable WHERE delay IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY video, signal ORDER BY frac DESC, delay) = 1
), marks AS (
  SELECT DISTINCT mark_id, replace(lower(regexp_replace(video_file, '\s', '', 'g')), '\', '/') AS video, msec FROM video_marks WHERE msec IS NOT NULL
), n AS (
  SELECT min(note_key) AS note_key, replace(lower(regexp_replace(wavfile, '\s', '', 'g')), '\', '/') AS signal, note_start
  FROM notes WHERE note_start IS NOT NULL AND NOT isnan(note_start) GROUP BY 2, 3
), near AS (
  SELECT m.mark_id, n.note_key, b.signal, round(abs(n.note_start - (m.msec / 1000 + b.delay)), 6) AS gap, n.note_start
  FROM marks m JOIN best b USING (video) JOIN n ON n.signal = b.signal
   AND n.note_start BETWEEN m.msec / 1000 + b.delay - 0.151 AND m.msec / 1000 + b.delay + 0.151
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY mark_id, signal ORDER BY gap, note_start, note_key) AS place FROM near WHERE gap <= 0.150
)
"""


@registry.query("p6_found", _DELAY + "SELECT mark_id, note_key FROM ranked WHERE place = 1")
def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Video marks with the note that starts nearest."""
    return p6_matched(spark, sf_dir).select("mark_id", "note_key")


@registry.query("p6_matched", _DELAY + "SELECT mark_id, note_key, gap FROM ranked WHERE place = 1")
def p6_matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Video marks with the note that starts nearest, and how far apart they are."""
    m = nearest.marks_to_notes(table(spark, sf_dir, "video_marks"), table(spark, sf_dir, "wav_video_delays"), table(spark, sf_dir, "notes"))
    return m.withColumn("gap", F.round("gap", 6))


@registry.query("p7_ids")
def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of each document."""
    return tokens.token_ids(table(spark, sf_dir, "documents"))


@registry.query("p8_packed")
def p8_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Container of each document or piece of one."""
    return packing.pack(tokens.token_counts(table(spark, sf_dir, "documents")), "doc_id", "n_tokens")


@registry.query("p8_containers")
def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Use of each container."""
    used = p8_packed(spark, sf_dir).groupBy("container").agg(F.count("*").alias("n_items"), F.sum("n").alias("used"))
    return used.withColumn("unused", packing.CAPACITY - F.col("used"))


@registry.query("p9_pieces")
def p9_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of the documents of more than 1,024 tokens."""
    return cutting.cut_texts(table(spark, sf_dir, "documents"))
