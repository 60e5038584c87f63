"""Audio files: block-wise reading, header, calibration, export.

Files are listed and opened by Spark (binaryFile); each is decoded in blocks, so that no row holds a
whole channel. Blocks overlap by `overlap` samples, the last one may be shorter; `own` is how many samples
a block doesn't share with the next. PCM of 8, 16, 24 and 32 bits is scaled to -1..1 unless raw is asked for.
Files that can't be decoded give one row with an error and no samples.
"""

from __future__ import annotations

import io
import struct
import wave
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ostinato.functions.exprs import little_endian
from ostinato.session import broadcast_if_small

BLOCKS = "path string, channel int, block long, t0 double, rate int, samples array<float>, own long, error string"
_SCALE = {1: 128.0, 2: 32768.0, 3: 8388608.0, 4: 2147483648.0}


def decode(content: bytes, raw: bool = False) -> tuple[np.ndarray, int]:
    """Samples (rows: time, columns: channels) and rate of a WAV file."""
    with wave.open(io.BytesIO(content)) as w:
        width, channels, rate = w.getsampwidth(), w.getnchannels(), w.getframerate()
        data = np.frombuffer(w.readframes(w.getnframes()), dtype=np.uint8)
    if width == 1:
        x = data.astype(np.float64) - 128
    elif width == 3:
        b = data[: len(data) // 3 * 3].reshape(-1, 3).astype(np.int32)
        x = (((b[:, 0] | b[:, 1] << 8 | b[:, 2] << 16) << 8) >> 8).astype(np.float64)
    else:
        x = data.view("<i2" if width == 2 else "<i4").astype(np.float64)
    x = x.reshape(-1, channels)
    return (x if raw else x / _SCALE[width]), rate


def encode(samples: np.ndarray, rate: int, peak: bool = True) -> bytes:
    """Samples (rows: time; columns, if any: channels) as 16-bit WAV, each channel normalised to its peak."""
    x = np.asarray(samples, dtype=np.float64)
    x = x.reshape(len(x), -1)
    top = np.abs(x).max(axis=0) if peak and len(x) else np.ones(x.shape[1])
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(x.shape[1])
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes(np.clip(np.round(x / np.where(top > 0, top, 1.0) * 32767), -32768, 32767).astype("<i2").tobytes())
    return out.getvalue()


def _pieces(content: bytes, block: int, overlap: int, raw: bool) -> Iterator[tuple[int, int, int, int, np.ndarray]]:
    """Block number, first sample, own samples, rate and samples of the blocks of a file, of which one is decoded at a time."""
    with wave.open(io.BytesIO(content)) as w:
        width, channels, rate, n = w.getsampwidth(), w.getnchannels(), w.getframerate(), w.getnframes()
        for i, start in enumerate(range(0, max(n, 1), block)):
            w.setpos(min(start, n))
            x = _samples(w.readframes(block + overlap), width, channels)
            yield i, start, min(block, n - start), rate, (x if raw else x / _SCALE[width])


def _samples(data: bytes, width: int, channels: int) -> np.ndarray:
    b = np.frombuffer(data, dtype=np.uint8)
    b = b[: len(b) // (width * channels) * width * channels]
    if width == 1:
        x = b.astype(np.float64) - 128
    elif width == 3:
        b = b.reshape(-1, 3).astype(np.int32)
        x = (((b[:, 0] | b[:, 1] << 8 | b[:, 2] << 16) << 8) >> 8).astype(np.float64)
    else:
        x = b.view("<i2" if width == 2 else "<i4").astype(np.float64)
    return x.reshape(-1, channels)


def decode(content: bytes, raw: bool = False) -> tuple[np.ndarray, int]:
    """Samples (rows: time, columns: channels) and rate of a WAV file."""
    _, _, _, rate, x = next(_pieces(content, 1 << 62, 0, raw))
    return x, rate


def read_blocks(spark: SparkSession, path: str, block: int = 1 << 18, overlap: int = 512, raw: bool = False) -> DataFrame:
    """Blocks of all channels of the audio files under path."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.[wW][aA][vV]").option("recursiveFileLookup", "true").load(path)
    return decoded(files, block, overlap, raw)


def decoded(files: DataFrame, block: int = 1 << 18, overlap: int = 512, raw: bool = False) -> DataFrame:
    """Blocks of files (path, content)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in batches:
            for name, content in zip(g["path"], g["content"], strict=True):
                try:
                    for i, start, own, rate, x in _pieces(content, block, overlap, raw):
                        yield pd.DataFrame(
                            {"path": name, "channel": np.arange(x.shape[1]), "block": i, "t0": start / rate, "rate": rate, "samples": list(x.T.astype(np.float32)), "own": own, "error": None}
                        )
                except (wave.Error, EOFError, ValueError, KeyError) as e:
                    yield pd.DataFrame({"path": [name], "channel": None, "block": None, "t0": None, "rate": None, "samples": None, "own": None, "error": str(e) or type(e).__name__})

    return files.select("path", "content").mapInPandas(run, BLOCKS)


def calibrated_blocks(blocks: DataFrame, channels: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Blocks of the kept channels (keys, ch_idx, name, gain, offset, keep), calibrated as (sample + offset) * gain."""
    side = broadcast_if_small(channels.withColumnRenamed("ch_idx", "channel"))
    j = blocks.join(side, [*keys, "channel"])
    value = F.transform("samples", lambda x: ((x + F.coalesce("offset", F.lit(0.0))) * F.coalesce("gain", F.lit(1.0))).cast("float"))
    return j.filter(F.coalesce("keep", F.lit(True))).select(*[c for c in blocks.columns if c != "samples"], "name", value.alias("samples"))


def headers(spark: SparkSession, path: str) -> DataFrame:
    """path, rate and bytes a second as the headers of audio files give them."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.[wW][aA][vV]").option("recursiveFileLookup", "true").load(path)
    return files.select("path", little_endian("content", 24).alias("rate"), little_endian("content", 28).alias("bytes_a_second"))


def with_rate(content: bytes, rate: int) -> bytes:
    """A WAV file with another sample rate in its header, bytes a second to match."""
    old, a_second = struct.unpack("<II", content[24:32])
    return content[:24] + struct.pack("<II", rate, rate * (a_second // max(old, 1))) + content[32:]
