"""Channel descriptions: calibration and choice of the base channel."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "channel_set string, ch_idx int, name string, type string, gain double, offset double, keep boolean, units string"
#: Calibration used by the queries: channel, gain, offset, keep.
CHANNELS = (("barrel", 1.0, 0.0, True), ("external", 1.02, -0.01, True), ("farfield", 0.98, 0.002, True), ("mouth", 0.5, 0.1, True), ("reed", 2.0, 0.05, True), ("tongue", 1.0, 0.0, False))
BASE_PRIORITY = ("barrel", "external", "farfield")


def channel_table(spark: SparkSession, sets: Mapping[str, Sequence[Mapping]]) -> DataFrame:
    """Channel sets, as parsed from a description file: the place in the list is the channel's number."""
    rows = [
        (name, i, c.get("name"), c.get("type"), float(c.get("gain", 1.0)), float(c.get("offset", 0.0)), bool(c.get("keep", True)), c.get("units"))
        for name, channels in sets.items()
        for i, c in enumerate(channels)
    ]
    return spark.createDataFrame(rows, SCHEMA)


def calibrated(df: DataFrame, channel: str, raw: str, channels: Sequence[tuple] = CHANNELS) -> DataFrame:
    """df with `value` = (raw + offset) * gain; channels that aren't described keep their values, those with keep = false go."""
    dim = df.sparkSession.createDataFrame(list(channels), f"`{channel}` string, gain double, offset double, keep boolean")
    x = df.join(F.broadcast(dim), channel, "left").filter(F.coalesce("keep", F.lit(True)))
    value = (F.col(raw) + F.coalesce("offset", F.lit(0.0))) * F.coalesce("gain", F.lit(1.0))
    return x.withColumn("value", value).drop("gain", "offset", "keep")


def base_channel(df: DataFrame, keys: Sequence[str], priority: Sequence[str] = BASE_PRIORITY, default: str = "farfield") -> DataFrame:
    """First channel of `priority` that each group has, else the default: keys, channel."""
    place = F.when(F.lit(False), F.lit(0))
    for i, name in enumerate(priority):
        place = place.when(F.col("channel") == name, F.lit(i))
    best = F.try_element_at(F.array(*[F.lit(p) for p in priority]), F.min(place) + 1)
    return df.groupBy(*keys).agg(F.coalesce(best, F.lit(default)).alias("channel"))
