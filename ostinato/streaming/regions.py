"""Streams of readings and detections: hopping frames, regions between silences, trackers with a memory.

All take and give streaming DataFrames (or plain ones); sinks and checkpoints are the caller's.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ostinato.operators import video
from ostinato.sources import wav


def hopping_frames(df: DataFrame, time: str, key: str, v: str, size: str = "1 second", hop: str = "500 milliseconds", late: str = "10 seconds") -> DataFrame:
    """Count, mean and root mean square of v in hopping windows of each key."""
    w = F.window(time, size, hop)
    return (
        df.withWatermark(time, late)
        .groupBy(key, w.alias("w"))
        .agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.sqrt(F.avg(F.col(v) * F.col(v))).alias("rms"))
        .select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "mean", "rms")
    )


def session_regions(df: DataFrame, time: str, key: str, gap: str = "500 milliseconds", late: str = "10 seconds") -> DataFrame:
    """Regions of each key without a pause of `gap`: first time, end (last time plus gap), number of rows."""
    return (
        df.withWatermark(time, late)
        .groupBy(key, F.session_window(time, gap).alias("w"))
        .agg(F.count("*").alias("n"))
        .select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
    )


def audio_blocks(spark: SparkSession, path: str, block: int = 1 << 18, overlap: int = 512) -> DataFrame:
    """Blocks of the audio files that come to be under path, as sources.wav.read_blocks gives them."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", "*.[wW][aA][vV]").load(path)
    return wav.decoded(files, block, overlap)


def _types(df: DataFrame, *columns: str) -> str:
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return ", ".join(f"`{c}` {kinds[c]}" for c in columns)


def _stateful(df: DataFrame, key: str, step: Callable, out: str, state: str, idle: float | None) -> DataFrame:
    """step(key, rows in the order they came, state or None) -> (result, new state), for each key.

    A key that gets no rows for `idle` seconds is forgotten. None keeps all, as a stream that ends with its source needs:
    one that waits for a time to pass never ends.
    """

    def run(k: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        if held.hasTimedOut:
            held.remove()
            return
        result, new = step(k[0], pd.concat(list(batches), ignore_index=True), held.get if held.exists else None)
        held.update(new)
        if idle is not None:
            held.setTimeoutDuration(int(idle * 1000))
        yield result

    timeout = GroupStateTimeout.NoTimeout if idle is None else GroupStateTimeout.ProcessingTimeTimeout
    return df.groupBy(key).applyInPandasWithState(run, out, state, "append", timeout)


def running_maximum(df: DataFrame, key: str, v: str, idle: float | None = None) -> DataFrame:
    """Rows of each key that exceed all before them, in the order they arrive."""

    def step(k, g: pd.DataFrame, state: tuple | None) -> tuple[pd.DataFrame, tuple]:
        top = state[0] if state else float("-inf")
        before = g[v].cummax().shift(fill_value=float("-inf")).clip(lower=top)
        return pd.DataFrame({key: k, v: g.loc[g[v] > before, v].to_numpy()}), (max(top, g[v].max()),)

    return _stateful(df, key, step, f"{_types(df, key)}, `{v}` double", "top double", idle)


def forgetting_tracker(df: DataFrame, key: str, seconds: str, v: str, forget: float = 1.0, idle: float | None = None) -> DataFrame:
    """Detections of each marker; one that is missing (null) keeps its last value for `forget` seconds, then is forgotten.

    Rows of a micro-batch are taken in order of time; state is the last value and when it was seen.
    """

    def step(k, g: pd.DataFrame, state: tuple | None) -> tuple[pd.DataFrame, tuple]:
        last, seen = state or (None, float("-inf"))
        rows = g.sort_values(seconds, kind="stable")
        out = []
        for t, x in zip(rows[seconds], rows[v], strict=True):
            if not pd.isna(x):
                last, seen = float(x), float(t)
            held = last is not None and t - seen <= forget
            out.append((k, float(t), last if held else None, pd.isna(x) and held))
        return pd.DataFrame(out, columns=[key, seconds, v, "held"]), (last, seen)

    return _stateful(df, key, step, f"{_types(df, key)}, `{seconds}` double, `{v}` double, held boolean", "last double, seen double", idle)


def kalman_forward(df: DataFrame, key: str, seconds: str, x: str = "x", y: str = "y", idle: float | None = None) -> DataFrame:
    """Position of each marker as it is known by what came up to each row (near constant velocity; null: not seen): key, seconds, x, y.

    Rows of a micro-batch are taken in order of time; state is the mean and the covariance.
    """

    def step(k, g: pd.DataFrame, state: tuple | None) -> tuple[pd.DataFrame, tuple]:
        rows = g.sort_values(seconds, kind="stable")
        z = rows[[x, y]].to_numpy(dtype=float)
        m, p = (np.array(state[0]), np.array(state[1]).reshape(4, 4)) if state else (None, None)
        out = np.full(z.shape, np.nan)
        for i, at in enumerate(z):
            seen = not np.isnan(at).any()
            if m is None and not seen:
                continue
            m, p = video.forward_step(m, p, at if seen else None)
            out[i] = m[:2]
        known = (m.tolist(), p.ravel().tolist()) if m is not None else (None, None)
        return pd.DataFrame({key: k, seconds: rows[seconds].to_numpy(dtype=float), x: out[:, 0], y: out[:, 1]}), known

    return _stateful(df, key, step, f"{_types(df, key)}, `{seconds}` double, `{x}` double, `{y}` double", "m array<double>, p array<double>", idle)


def drained(df: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """All that a stream gives for what its source holds now, written to and read back from `folder`, which all executors share.

    The state and the progress are kept there as well: run again, only what is new in the source is read. Each batch has
    a folder of its own, so that one which is run again after a loss replaces itself. mode complete replaces the result,
    append adds to it.
    """

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/result/batch={0 if mode == 'complete' else number}")

    q = df.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/progress").foreachBatch(put).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/result").select(*df.columns)
