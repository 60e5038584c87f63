"""Queries of the general training-data problems: p1 (grid), p2 (faults), p4 (hot deck)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ostinato.operators import faults, grid, hotdeck
from ostinato.plans.registry import Registry
from ostinato.session import table

registry = Registry()

_SLOTS = """
WITH h AS (SELECT series_id, t0, dt, n_slots FROM series),
seen AS (
  SELECT DISTINCT h.series_id, floor((r.t - h.t0) / h.dt + 0.5) AS k
  FROM readings r JOIN h ON r.series_id = h.series_id
  WHERE r.t IS NOT NULL AND NOT isnan(r.t) AND r.v IS NOT NULL AND NOT isnan(r.v)
),
slots AS (SELECT series_id, t0, dt, CAST(unnest(range(n_slots)) AS INT) AS slot FROM h)
"""


@registry.query(
    "p1_found",
    _SLOTS + "SELECT s.series_id, s.slot FROM slots s LEFT JOIN seen x ON x.series_id = s.series_id AND x.k = s.slot WHERE x.k IS NULL",
)
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slots without a reading."""
    return grid.uncovered_slots(table(spark, sf_dir, "readings"), table(spark, sf_dir, "series"))


@registry.query(
    "p1_grid",
    """
WITH h AS (SELECT series_id, t0, dt, n_slots FROM series),
once AS (
  SELECT r.series_id, r.frame_idx, floor((r.t - h.t0) / h.dt + 0.5) AS k, any_value(r.v) AS v
  FROM readings r JOIN h ON r.series_id = h.series_id
  WHERE r.t IS NOT NULL AND NOT isnan(r.t) AND r.v IS NOT NULL AND NOT isnan(r.v)
  GROUP BY ALL
),
cells AS (SELECT series_id, k, avg(v) AS v, count(*) AS n FROM once GROUP BY ALL),
slots AS (SELECT series_id, t0, dt, CAST(unnest(range(n_slots)) AS INT) AS slot FROM h)
SELECT s.series_id, s.slot, round(s.t0 + s.slot * s.dt, 6) AS t, round(c.v, 8) AS v, coalesce(c.n, 0) AS n_readings, c.n IS NULL AS is_gap
FROM slots s LEFT JOIN cells c ON c.series_id = s.series_id AND c.k = s.slot
""",
)
def p1_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every slot of every series with its value or a mark."""
    g = grid.level_grid(table(spark, sf_dir, "readings"), table(spark, sf_dir, "series"))
    return g.withColumns({"t": F.round("t", 6), "v": F.round("v", 8)})


@registry.query(
    "p1_counter",
    """
WITH h AS (SELECT series_id, t0, dt, n_slots FROM series),
once AS (
  SELECT DISTINCT r.series_id, r.frame_idx, CAST(r.frame_idx AS DOUBLE) AS v, (r.t - h.t0) / h.dt + 0.5 AS pos, h.n_slots
  FROM readings r JOIN h ON r.series_id = h.series_id WHERE r.t IS NOT NULL AND NOT isnan(r.t)
), pairs AS (
  SELECT series_id, n_slots, pos AS b, v, lag(pos) OVER w AS a, lag(v) OVER w AS u FROM once WHERE pos >= -9 AND pos < n_slots + 9
  WINDOW w AS (PARTITION BY series_id ORDER BY pos, frame_idx)
), cells AS (
  SELECT *, unnest(range(CAST(greatest(floor(a), 0) AS BIGINT), CAST(least(floor(b), n_slots - 1) AS BIGINT) + 1)) AS k FROM pairs WHERE b - a <= 8
), sums AS (
  SELECT series_id, k, sum(CASE WHEN v < u THEN v ELSE v - u END * CASE WHEN b > a THEN (least(b, k + 1) - greatest(a, k)) / (b - a) ELSE 1 END) AS increment,
    count(*) FILTER (v < u AND k = floor(b)) AS n_resets, least(sum(CASE WHEN b > a THEN least(b, k + 1) - greatest(a, k) ELSE 0 END), 1.0) AS covered
  FROM cells GROUP BY ALL
), slots AS (SELECT series_id, CAST(unnest(range(n_slots)) AS INT) AS slot FROM h)
SELECT s.series_id, s.slot, round(x.increment, 6) AS increment, coalesce(x.n_resets, 0) AS n_resets, round(CAST(coalesce(x.covered, 0) AS DOUBLE), 6) AS covered
FROM slots s LEFT JOIN sums x ON x.series_id = s.series_id AND x.k = s.slot
""",
)
def p1_counter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames that fall to each slot: the frame number of the readings is a cumulative counter."""
    r = table(spark, sf_dir, "readings").withColumn("v", F.col("frame_idx").cast("double"))
    g = grid.counter_grid(r, table(spark, sf_dir, "series"))
    return g.withColumns({"increment": F.round("increment", 6), "covered": F.round("covered", 6)})


@registry.query("p1_counter_with_resets", registry.sql["p1_counter"].replace("CAST(r.frame_idx AS DOUBLE)", "CAST(r.frame_idx % 100 AS DOUBLE)"))
def p1_counter_with_resets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same of a counter that starts again from 0 after every 100 frames."""
    r = table(spark, sf_dir, "readings").withColumn("v", (F.col("frame_idx") % 100).cast("double"))
    g = grid.counter_grid(r, table(spark, sf_dir, "series"))
    return g.withColumns({"increment": F.round("increment", 6), "covered": F.round("covered", 6)})


@registry.query("p2_found")
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faulty readings."""
    return p2_flags(spark, sf_dir).select("series_id", F.col("frame_idx").cast("int").alias("frame_idx")).distinct()


@registry.query("p2_flags")
def p2_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faulty readings with reason, score and cutoff."""
    return faults.flag_faults(table(spark, sf_dir, "readings"), table(spark, sf_dir, "label_limits"))


_NO_NUMBER = "SELECT note_key, '{0}' AS field FROM n WHERE {0} IS NULL OR isnan({0}) OR {0} <= {1} OR {0} > {2}"
_MISSING = f"""
WITH n AS (SELECT DISTINCT note_key, f0_avg, ext_ampl_avg, instrument FROM notes)
{" UNION ALL ".join(_NO_NUMBER.format(c, *hotdeck.NOTE_LIMITS[c]) for c in hotdeck.NOTE_LIMITS)}
UNION ALL
SELECT note_key, 'instrument' FROM n WHERE instrument IS NULL OR lower(trim(instrument)) NOT IN {hotdeck.INSTRUMENTS}
"""


@registry.query("p4_found", _MISSING)
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing values of notes, as the hot deck fills and marks them."""
    return hotdeck.fill_notes(table(spark, sf_dir, "notes")).select("note_key", "field")


@registry.query("p4_filled")
def p4_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing values of notes with what they are filled with and the donors."""
    return hotdeck.fill_notes(table(spark, sf_dir, "notes"))
