"""Metadata: lists of recordings, scores, runs of a session, detections, and sinks for tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

RECORDINGS = "idx int, filename string, tune string, own boolean, sensor_set int, subject_id int, channel_set string, instrument string"
SCORE = "tune string, score_idx int, note_id int, pitch string, beats double, strong_beat boolean, ornament boolean, staccato boolean, bar int"
DETECTIONS = "video string, msec double, markers map<string,struct<bbox:array<int>,source:string,template_val:double>>"


def read_recordings(spark: SparkSession, path: str) -> DataFrame:
    """The list of recordings; empty tunes are null."""
    return spark.read.csv(path, header=True, schema=RECORDINGS, enforceSchema=True).withColumn("tune", F.nullif(F.trim("tune"), F.lit("")))


def score_table(spark: SparkSession, scores: Mapping[str, Mapping]) -> DataFrame:
    """Scores, as parsed from a description: score_idx counts rests (pitch 0), note_id doesn't and is null for them."""
    rows = []
    for tune, s in scores.items():
        sounding = 0
        for i, n in enumerate(s["notes"]):
            rest = n.get("pitch") in (0, "0", None)
            rows.append((tune, i, None if rest else sounding, None if rest else str(n["pitch"]), float(n["duration"]), n.get("strong_beat"), n.get("ornament"), n.get("staccato"), s.get("bar_duration")))
            sounding += not rest
    return spark.createDataFrame(rows, SCORE)


def score_from_json(documents: DataFrame, text: str = "text") -> DataFrame:
    """Scores, one document each: tune, score_idx, which counts rests (pitch 0), note_id, which doesn't and is null for them, pitch, beats."""
    schema = "tune string, notes array<struct<pitch:string,duration:double>>"
    x = documents.select(F.from_json(text, schema).alias("s")).select("s.tune", F.posexplode("s.notes").alias("score_idx", "n"))
    rest = F.coalesce(F.col("n.pitch"), F.lit("0")) == "0"
    w = Window.partitionBy("tune").orderBy("score_idx")
    x = x.withColumn("note_id", F.when(~rest, F.sum((~rest).cast("int")).over(w).cast("int") - 1))
    return x.select("tune", "score_idx", "note_id", F.when(~rest, F.col("n.pitch")).alias("pitch"), F.col("n.duration").alias("beats"))


def beat_starts(score: DataFrame) -> DataFrame:
    """beat_start: beats before each note of its tune, rests included."""
    w = Window.partitionBy("tune").orderBy("score_idx").rowsBetween(Window.unboundedPreceding, -1)
    return score.withColumn("beat_start", F.coalesce(F.sum("beats").over(w), F.lit(0.0)))


def flatten_runs(runs: DataFrame) -> DataFrame:
    """Files of runs (run struct<...>, files array<struct<filename, tune, channels, ...>>): what a file says goes before what its run says."""
    x = runs.select("run", F.explode("files").alias("file"))
    run, file = (set(x.schema[c].dataType.names) for c in ("run", "file"))
    both = [F.coalesce(F.col(f"file.{c}"), F.col(f"run.{c}")).alias(c) for c in sorted(run & file)]
    only = [F.col(f"file.{c}").alias(c) for c in sorted(file - run)] + [F.col(f"run.{c}").alias(c) for c in sorted(run - file)]
    return x.select(*both, *only)


def merge_runs(files: DataFrame, regions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Files with their regions inlined as an array, empty where there are none."""
    r = regions.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("start", "end", "label"))).alias("regions"))
    return files.join(r, list(keys), "left").withColumn("regions", F.coalesce("regions", F.array().cast(r.schema["regions"].dataType)))


def nth_file(files: DataFrame, keys: Sequence[str], order: str, n: int) -> DataFrame:
    """The n-th file (from 1) of each run (keys): the share of the n-th of several independent jobs."""
    w = Window.partitionBy(*keys).orderBy(order)
    return files.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") == n).drop("__n")


def with_melody(files: DataFrame, scores: DataFrame) -> DataFrame:
    """Files with the notes of their tune as an array; null for tunes without a score."""
    s = scores.groupBy("tune").agg(F.sort_array(F.collect_list(F.struct("score_idx", "pitch", "beats"))).alias("melody"))
    return files.join(s, "tune", "left")


def read_detections(spark: SparkSession, path: str) -> DataFrame:
    """Detections in video frames, one JSON object a line: path, video, msec, marker_id, bbox, source, template_val."""
    raw = spark.read.json(path, schema=DETECTIONS).withColumn("path", F.input_file_name())
    x = raw.select("path", "video", "msec", F.explode_outer("markers").alias("id", "m"))
    return x.select("path", "video", "msec", F.col("id").try_cast("int").alias("marker_id"), "m.bbox", "m.source", "m.template_val")


def filter_videos(videos: DataFrame, views: Sequence[str]) -> DataFrame:
    return videos.filter(F.col("view").isin(*views))


def assemble_series(*parts: DataFrame) -> DataFrame:
    """Series of several sources as one table; columns that a source lacks are null."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def write_series(series: DataFrame, path: str, by: str = "rec_id", files: int | None = None) -> None:
    """Series as Parquet in `files` files (as many as shuffle partitions), recordings hashed to them and sorted, so that a filter on recordings or labels skips row groups."""
    n = files or int(series.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    series.repartition(n, by).sortWithinPartitions(by, "label").write.mode("overwrite").parquet(path)


def write_regions(regions: DataFrame, path: str, sep: str = ",") -> None:
    """Regions as delimited text; an existing path is an error."""
    regions.write.mode("errorifexists").csv(path, header=True, sep=sep)


def split_by_key(df: DataFrame, key: str, path: str) -> None:
    """One folder of JSON for each value of key."""
    df.write.mode("errorifexists").partitionBy(key).json(path)
