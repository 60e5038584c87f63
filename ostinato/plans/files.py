"""Queries on sources and sinks: what the tables hold is written to files in the shared folder and read back."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ostinato.operators.grouped import per_group
from ostinato.plans import views
from ostinato.plans.notes import _SCORE, _score
from ostinato.plans.registry import Registry
from ostinato.plans.series import _DIM
from ostinato.plans.views import H, N, R, path_sql, rounded
from ostinato.session import broadcast_if_small, path_key, shared_folder, table
from ostinato.sources import channels, files, metadata, textgrid, wav

registry = Registry()


def _sql(text: str, *ctes: str) -> str:
    return "WITH " + ", ".join(ctes) + "\n" + text


@registry.query(
    "textgrid_round_trip",
    _sql("""SELECT name, tier, CAST(row_number() OVER (PARTITION BY name, tier ORDER BY "start", "end", label) - 1 AS INT) AS idx, "start", "end", label FROM (
  SELECT ltrim(regexp_replace(file, '[^A-Za-z0-9_.-]+', '_', 'g'), '_') AS name, * EXCLUDE (file) FROM (
    SELECT file, 'note' AS tier, "start", "end", CASE WHEN trim(note_label) <> '' THEN note_label ELSE 'note ' || CAST(row_number() OVER (PARTITION BY file ORDER BY "start", note_key) AS VARCHAR) END AS label FROM n
    UNION ALL SELECT file, 'clip', min("start"), max("end"), 'clip ' || coalesce(CAST(ver_nbr AS VARCHAR), '?') FROM n GROUP BY file, ver_nbr))""", N),
)
def textgrid_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Notes and takes of each file as tiers of a text grid, written and read back; notes without a label are numbered."""
    n = views.notes(spark, d)
    number = F.row_number().over(Window.partitionBy("file").orderBy("start", "note_key"))
    own = F.when(F.trim("note_label") != "", F.col("note_label"))
    note = n.select(F.col("file").alias("path"), F.lit("note").alias("tier"), "start", "end", F.coalesce(own, F.format_string("note %d", number)).alias("label"))
    clip = n.groupBy("file", "ver_nbr").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    clip = clip.select(F.col("file").alias("path"), F.lit("clip").alias("tier"), "start", "end", F.concat(F.lit("clip "), F.coalesce(F.col("ver_nbr").cast("string"), F.lit("?"))).alias("label"))
    folder = shared_folder(spark, "grids")
    textgrid.write_texts(textgrid.as_texts(note.unionByName(clip)), folder)
    name = F.regexp_extract("path", r"([^/]+)\.TextGrid$", 1).alias("name")
    return textgrid.read_intervals(spark, folder).select(name, "tier", "idx", "start", "end", "label")


_AUDIO = """c AS (
  SELECT rec_id, label, dense_rank() OVER (PARTITION BY rec_id ORDER BY label) - 1 AS channel, v, max(abs(v)) OVER (PARTITION BY rec_id, label) AS top, dt
  FROM (SELECT h.rec_id, h.label, r.v, s.dt FROM r JOIN h USING (series_id) JOIN series s USING (series_id) WHERE h.label IN ('barrel_ampl', 'external_ampl'))
), q AS (SELECT rec_id, label, channel, min(dt) AS dt, count(*) AS held, sum(s) AS total, max(s) AS most FROM (
  SELECT *, greatest(-32768, least(32767, round_even(v / CASE WHEN top > 0 THEN top ELSE 1 END * 32767, 0))) AS s FROM c) GROUP BY ALL
), l AS (SELECT *, max(held) OVER (PARTITION BY rec_id) AS n, min(dt) OVER (PARTITION BY rec_id) AS step FROM q)"""


def audio_files(spark: SparkSession, d: str) -> str:
    """The amplitudes at the barrel and outside of each recording as the channels of a WAV file; the folder of the files."""
    h = views.headers(spark, d).join(table(spark, d, "series").select("series_id", "dt"), "series_id").filter(F.col("label").isin("barrel_ampl", "external_ampl"))
    r = views.readings(spark, d).drop("label").join(broadcast_if_small(h.select("series_id", "rec_id", "label", "dt")), "series_id")

    def run(g: pd.DataFrame) -> pd.DataFrame:
        tracks = [x["v"].to_numpy() for _, x in g.groupby("label", sort=True)]
        samples = np.zeros((max(map(len, tracks)), len(tracks)))
        for i, v in enumerate(tracks):
            samples[: len(v), i] = v
        return pd.DataFrame({"content": [wav.encode(samples, int(round(1 / g["dt"].min())))]})

    whole = per_group(r.select("rec_id", "label", "series_id", "frame_idx", "v", "dt"), ["rec_id"], run, "content binary", ["label", "series_id", "frame_idx"])
    folder = shared_folder(spark, "audio")
    files.write_files(whole.select(F.concat(F.col("rec_id").cast("string"), F.lit(".wav")).alias("name"), "content"), folder)
    return folder


def _rec_id():
    return F.regexp_extract("path", r"(\d+)\.wav$", 1).cast("long").alias("rec_id")


@registry.query(
    "wav_round_trip",
    _sql("SELECT rec_id, CAST(channel AS INT) AS channel, CAST(round_even(1 / step, 0) AS BIGINT) AS rate, n, CAST(total AS BIGINT) AS total, CAST(greatest(most, CASE WHEN held < n THEN 0 ELSE most END) AS BIGINT) AS most FROM l", R, H, _AUDIO),
)
def wav_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Recordings as audio files of several channels, normalised to their peaks, written and read back in blocks: rate of the header, samples of each channel."""
    folder = audio_files(spark, d)
    b = wav.read_blocks(spark, folder, block=256, overlap=32, raw=True).select("path", "channel", F.slice("samples", 1, F.greatest(F.col("own"), F.lit(0)).cast("int")).alias("s"))
    sums = b.select("path", "channel", F.size("s").alias("n"), F.aggregate("s", F.lit(0.0), lambda a, x: a + x).alias("total"), F.array_max("s").alias("most"))
    sums = sums.groupBy("path", "channel").agg(F.sum("n").alias("n"), F.sum("total").cast("long").alias("total"), F.max("most").cast("long").alias("most"))
    x = sums.join(wav.headers(spark, folder), "path")
    return x.select(_rec_id(), "channel", "rate", "n", "total", "most")


@registry.query(
    "wav_calibrated",
    _sql("SELECT rec_id, split_part(label, '_', 1) AS name, n, round((CAST(greatest(most, CASE WHEN held < n THEN 0 ELSE most END) AS DOUBLE) / 32768 + \"offset\") * gain, 3) AS top FROM l JOIN dim ON dim.channel = split_part(l.label, '_', 1) WHERE keep", R, H, _AUDIO, _DIM),
)
def wav_calibrated(spark: SparkSession, d: str) -> DataFrame:
    """The same files with their channels calibrated by the description of their channels: how many samples, and the highest."""
    h = views.headers(spark, d).filter(F.col("label").isin("barrel_ampl", "external_ampl")).select("rec_id", F.split_part("label", F.lit("_"), F.lit(1)).alias("name")).distinct()
    place = h.withColumn("ch_idx", F.row_number().over(Window.partitionBy("rec_id").orderBy("name")) - 1)
    dim = spark.createDataFrame([c for c in channels.CHANNELS], "name string, gain double, offset double, keep boolean")
    described = place.join(F.broadcast(dim), "name", "left")
    blocks = wav.read_blocks(spark, audio_files(spark, d), block=256, overlap=0).withColumn("rec_id", _rec_id())
    x = wav.calibrated_blocks(blocks, described, ["rec_id"])
    g = x.groupBy("rec_id", "name").agg(F.sum(F.size("samples")).alias("n"), F.max(F.array_max("samples")).cast("double").alias("top"))
    return rounded(g, 3, "top")


@registry.query(
    "region_samples",
    _sql("""SELECT h.rec_id, r.series_id, count(*) AS n, min(r.v) AS low, max(r.v) AS high FROM r JOIN h USING (series_id) JOIN series s USING (series_id)
JOIN (SELECT file, "start", "end" FROM n WHERE regexp_matches(note_label, '^(?:2\\()') QUALIFY row_number() OVER (PARTITION BY file ORDER BY "start", note_key) = 1) g ON g.file = h.file
WHERE r.label = 'barrel_ampl' AND r.frame_idx >= floor((g."start" - s.t0) / s.dt) AND r.frame_idx < floor((g."end" - s.t0) / s.dt) GROUP BY ALL""", R, H, N),
)
def region_samples(spark: SparkSession, d: str) -> DataFrame:
    """Samples of each recording within the first of its regions whose label begins as asked."""
    n = views.notes(spark, d).select(F.col("file").alias("path"), F.lit("note").alias("tier"), F.col("note_key").alias("idx"), "start", "end", F.col("note_label").alias("label"))
    region = textgrid.first_label_region(n, r"2\(").select(F.col("path").alias("file"), "start", "end")
    h = views.headers(spark, d).drop("label").join(table(spark, d, "series").select("series_id", "t0", "dt"), "series_id").join(region, "file")
    at = lambda t: F.floor((F.col(t) - F.col("t0")) / F.col("dt"))
    spans = h.select("series_id", "rec_id", at("start").alias("a"), at("end").alias("b"))
    x = views.readings(spark, d).filter("label = 'barrel_ampl'").join(broadcast_if_small(spans), "series_id").filter("frame_idx >= a AND frame_idx < b")
    return x.groupBy("rec_id", "series_id").agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))


@registry.query("series_store", _sql("SELECT h.rec_id, r.label, count(*) AS n, min(r.v) AS low, max(r.v) AS high FROM r JOIN h USING (series_id) WHERE r.label IN ('mouth_dc', 'reed_dc') GROUP BY ALL", R, H))
def series_store(spark: SparkSession, d: str) -> DataFrame:
    """Series written as a store that is sorted by recording and label, and two labels read back from it."""
    folder = shared_folder(spark, "series")
    metadata.write_series(views.points(spark, d).select("rec_id", "label", "t", "v"), folder)
    x = spark.read.parquet(folder).filter(F.col("label").isin("mouth_dc", "reed_dc"))
    return x.groupBy("rec_id", "label").agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))


@registry.query("regions_as_text", _sql('SELECT file, ver_nbr, min("start") AS ts, max("end") AS te FROM n GROUP BY ALL', N))
def regions_as_text(spark: SparkSession, d: str) -> DataFrame:
    """Extents of takes as tab-separated text, written and read back."""
    folder = shared_folder(spark, "regions") + "/out"
    x = views.notes(spark, d).groupBy("file", "ver_nbr").agg(F.min("start").alias("ts"), F.max("end").alias("te"))
    metadata.write_regions(x, folder, "\t")
    return spark.read.csv(folder, header=True, sep="\t", schema="file string, ver_nbr int, ts double, te double")


@registry.query(
    "detections_as_json",
    f"""SELECT video, msec, marker_id, x, y, w, source, template_val FROM (SELECT {path_sql('video_file')} AS video, msec, marker_id, bbox[1] AS x, bbox[2] AS y, bbox[3] AS w, source, CASE WHEN NOT isnan(template_val) THEN template_val END AS template_val
FROM video_marks WHERE marker_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY {path_sql('video_file')}, msec, marker_id ORDER BY mark_id) = 1)""",
)
def detections_as_json(spark: SparkSession, d: str) -> DataFrame:
    """Frames of videos with a map from marker to detection, written as JSON and read back one row for each marker."""
    m = views.marks(spark, d).filter("marker_id IS NOT NULL")
    one = F.struct(F.array("x", "y", "w", "h").alias("bbox"), "source", "template_val")
    m = m.groupBy("video", "msec", "marker_id").agg(F.min_by(one, "mark_id").alias("m"))
    frames = m.groupBy("video", "msec").agg(F.map_from_entries(F.collect_list(F.struct(F.col("marker_id").cast("string"), "m"))).alias("markers"))
    folder = shared_folder(spark, "detections") + "/out"
    frames.write.json(folder)
    x = metadata.read_detections(spark, folder)
    return x.select("video", "msec", "marker_id", F.col("bbox")[0].alias("x"), F.col("bbox")[1].alias("y"), F.col("bbox")[2].alias("w"), "source", "template_val")


@registry.query(
    "recording_list",
    f"SELECT CAST(rec_id AS INT) AS idx, {path_sql('filename')} AS file, nullif(trim(r.tune), '') AS tune, own, subject_id, channel_set, n_notes FROM recordings r LEFT JOIN (SELECT tune, count(*) AS n_notes FROM (SELECT DISTINCT tune, note_id FROM s) GROUP BY tune) m ON m.tune = nullif(trim(r.tune), '')".join(("WITH " + N + ", " + _SCORE.replace("score AS", "s AS", 1) + "\n", "")),
)
def recording_list(spark: SparkSession, d: str) -> DataFrame:
    """The list of recordings as delimited text, written and read back, with the melody of the tune of each."""
    folder = shared_folder(spark, "list") + "/out"
    r = table(spark, d, "recordings").select(F.col("rec_id").cast("int").alias("idx"), "filename", "tune", "own", "sensor_set", "subject_id", "channel_set", "instrument")
    r.write.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(folder, header=True, escape='"')
    s = _score(spark, d).select("tune", F.col("note_id").alias("score_idx"), "pitch", F.lit(1.0).alias("beats"))
    x = metadata.with_melody(metadata.read_recordings(spark, folder), s)
    return x.select("idx", path_key("filename").alias("file"), "tune", "own", "subject_id", "channel_set", F.when(F.col("melody").isNotNull(), F.size("melody").cast("long")).alias("n_notes"))


_VIEW = f"SELECT DISTINCT video, regexp_extract(video, '_([a-z]+)[.]mp4$', 1) AS \"view\" FROM (SELECT {path_sql('video_file')} AS video FROM video_marks)"


@registry.query("video_list", f"SELECT * FROM ({_VIEW}) WHERE \"view\" IN ('front', 'side')")
def video_list(spark: SparkSession, d: str) -> DataFrame:
    """Videos of two kinds of view."""
    v = table(spark, d, "video_marks").select(path_key("video_file").alias("video")).distinct().withColumn("view", F.regexp_extract("video", "_([a-z]+)[.]mp4$", 1))
    return metadata.filter_videos(v, ["front", "side"])


@registry.query(
    "score_documents",
    _sql("""SELECT tune, CAST(row_number() OVER (PARTITION BY tune ORDER BY note_id, rest) - 1 AS INT) AS score_idx, CASE WHEN NOT rest THEN CAST(row_number() OVER (PARTITION BY tune, rest ORDER BY note_id) - 1 AS INT) END AS note_id, pitch, beats
FROM (SELECT tune, note_id, FALSE AS rest, pitch, 1.0::DOUBLE AS beats FROM score UNION ALL SELECT tune, note_id, TRUE, NULL, 0.5 FROM score WHERE pitch LIKE 'A%')""", N, _SCORE),
)
def score_documents(spark: SparkSession, d: str) -> DataFrame:
    """Scores as documents of nested notes, with a rest after every A, made into rows with both ways of counting notes."""
    s = _score(spark, d)
    note = F.struct("note_id", F.lit(0).alias("k"), "pitch", F.lit(1.0).alias("duration"))
    rest = F.when(F.col("pitch").startswith("A"), F.struct("note_id", F.lit(1).alias("k"), F.lit("0").alias("pitch"), F.lit(0.5).alias("duration")))
    notes = s.select("tune", F.explode(F.array_compact(F.array(note, rest))).alias("n")).groupBy("tune").agg(F.sort_array(F.collect_list("n")).alias("n"))
    text = notes.select(F.to_json(F.struct("tune", F.transform("n", lambda x: F.struct(x["pitch"].alias("pitch"), x["duration"].alias("duration"))).alias("notes"))).alias("text"))
    return metadata.score_from_json(text)


_FOLDER = f"SELECT rec_id, {path_sql('filename')} AS file, regexp_extract({path_sql('filename')}, '^(.*)/[^/]*$', 1) AS folder, nullif(trim(tune), '') AS tune, nullif(channel_set, 'default') AS channel_set FROM recordings"


def _listed(spark: SparkSession, d: str) -> DataFrame:
    file = path_key("filename")
    return table(spark, d, "recordings").select("rec_id", file.alias("file"), F.regexp_extract(file, r"^(.*)/[^/]*$", 1).alias("folder"), F.nullif(F.trim("tune"), F.lit("")).alias("tune"), F.nullif("channel_set", F.lit("default")).alias("channel_set"))


@registry.query("run_files", f"SELECT rec_id, file, folder, tune, coalesce(channel_set, 'default') AS channel_set FROM ({_FOLDER})")
def run_files(spark: SparkSession, d: str) -> DataFrame:
    """Files of runs, a folder each: what a file says about its channels goes before what its run says."""
    runs = _listed(spark, d).groupBy("folder").agg(F.collect_list(F.struct("rec_id", "file", "tune", "channel_set")).alias("files"))
    runs = runs.select(F.struct("folder", F.lit("default").alias("channel_set")).alias("run"), "files")
    return metadata.flatten_runs(runs).select("rec_id", "file", "folder", "tune", "channel_set")


@registry.query(
    "run_regions",
    _sql(f'SELECT f.rec_id, CAST(row_number() OVER (PARTITION BY f.rec_id ORDER BY c."start", c."end") AS BIGINT) AS region, c."start", c."end" FROM ({_FOLDER}) f JOIN (SELECT file, ver_nbr, min("start") AS "start", max("end") AS "end" FROM n GROUP BY ALL) c ON c.file = f.file', N),
)
def run_regions(spark: SparkSession, d: str) -> DataFrame:
    """Regions of the files of runs: inlined with their file, then one row each."""
    clips = views.notes(spark, d).groupBy("file", "ver_nbr").agg(F.min("start").alias("start"), F.max("end").alias("end")).withColumn("label", F.col("ver_nbr").cast("string"))
    merged = metadata.merge_runs(_listed(spark, d).select("rec_id", "file"), clips, ["file"])
    return merged.select("rec_id", F.posexplode("regions").alias("region", "r")).select("rec_id", (F.col("region") + 1).cast("long").alias("region"), "r.start", "r.end")


@registry.query("second_of_folder", f"SELECT rec_id, file, folder FROM ({_FOLDER}) QUALIFY row_number() OVER (PARTITION BY folder ORDER BY rec_id) = 2")
def second_of_folder(spark: SparkSession, d: str) -> DataFrame:
    """The second file of each run, as the second of several jobs would take it."""
    return metadata.nth_file(_listed(spark, d).select("rec_id", "file", "folder"), ["folder"], "rec_id", 2)


@registry.query("split_documents", f"SELECT tune, count(*) AS n, min(rec_id) AS first FROM ({_FOLDER}) WHERE tune IS NOT NULL GROUP BY tune")
def split_documents(spark: SparkSession, d: str) -> DataFrame:
    """The list of recordings split into a folder of documents for each tune, read back from there."""
    folder = shared_folder(spark, "split") + "/out"
    metadata.split_by_key(_listed(spark, d).filter("tune IS NOT NULL").select("tune", "rec_id", "file"), "tune", folder)
    x = spark.read.schema("rec_id long, file string, tune string").json(folder)
    return x.groupBy("tune").agg(F.count("*").alias("n"), F.min("rec_id").alias("first"))
