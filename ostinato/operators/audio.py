"""Fingerprints, power and delays of audio blocks (path, channel, block, t0, rate, samples, own; see sources.wav)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ostinato.operators import sync, windows
from ostinato.operators.signals import correlation_delay, find_peaks, frames
from ostinato.session import checkpointed

PEAKS = "path string, channel int, block long, frame long, bin int, power double, threshold double"
POWER = "path string, channel int, frame long, t double, power double"


def spectrogram(x: np.ndarray, size: int, hop: int) -> np.ndarray:
    """Power of each full frame (rows) at each frequency (columns), Hann window."""
    return np.abs(np.fft.rfft(frames(np.asarray(x, dtype=float), size, hop) * np.hanning(size), axis=1)) ** 2


def largest_around(m: np.ndarray, rows: int, columns: int) -> np.ndarray:
    """Largest value within `rows` and `columns` on either side, one direction after the other."""
    for axis, r in ((0, rows), (1, columns)):
        pad = [(0, 0), (0, 0)]
        pad[axis] = (r, r)
        m = np.lib.stride_tricks.sliding_window_view(np.pad(m, pad, constant_values=-np.inf), 2 * r + 1, axis=axis).max(axis=-1)
    return m


def spectral_peaks(blocks: DataFrame, size: int = 2048, around_hz: float = 60.0, around_s: float = 0.3, percentile: float = 99.0, fmin: float = 60.0, fmax: float = 11000.0) -> DataFrame:
    """Local maxima of the spectrogram (hop of half a frame) above the highest of the blocks' percentiles of a file.

    A threshold that only rises from block to block ends at that maximum, so blocks may come in any order.
    """

    def run(batches):
        for g in batches:
            for b in g.itertuples(index=False):
                hop = size // 2
                m = spectrogram(b.samples, size, hop)
                if not len(m):
                    continue
                thr = float(np.percentile(m, percentile))
                top = (m == largest_around(m, max(1, round(around_s * b.rate / hop)), max(1, round(around_hz * size / b.rate)))) & (m >= thr) & (m > 0)
                f, k = np.nonzero(top)
                ok = (f * hop < b.own) & (k > fmin * size / b.rate) & (k < fmax * size / b.rate)
                first = round(b.t0 * b.rate / hop)
                yield pd.DataFrame({"path": b.path, "channel": b.channel, "block": b.block, "frame": f[ok] + first, "bin": k[ok], "power": m[f[ok], k[ok]], "threshold": thr})

    found = blocks.mapInPandas(run, PEAKS)
    top = found.groupBy("path", "channel").agg(F.max("threshold").alias("__top"))
    return found.join(top, ["path", "channel"]).filter(F.col("power") >= F.col("__top")).drop("__top", "threshold")


def band_power(blocks: DataFrame, size: int = 2048, fmin: float = 60.0, fmax: float = 11000.0) -> DataFrame:
    """Power between two frequencies of each frame."""

    def run(batches):
        for g in batches:
            for b in g.itertuples(index=False):
                hop = size // 2
                m = spectrogram(b.samples, size, hop)
                m = m[np.arange(len(m)) * hop < b.own]
                lo, hi = int(fmin * size / b.rate), int(np.ceil(fmax * size / b.rate))
                t = b.t0 + (np.arange(len(m)) * hop + size / 2) / b.rate
                yield pd.DataFrame({"path": b.path, "channel": b.channel, "frame": np.arange(len(m)) + round(b.t0 * b.rate / hop), "t": t, "power": m[:, lo:hi].sum(axis=1)})

    return blocks.mapInPandas(run, POWER)


def sounding_regions(power: DataFrame, min_silence: float = 0.5) -> DataFrame:
    """Regions of each file whose level is above the middle of its 5th and 95th percentile; shorter silences don't split them."""
    keys = ["path", "channel"]
    db = power.withColumn("db", 10 * F.log10(F.greatest("power", F.lit(1e-12))))
    edge = db.groupBy(*keys).agg(F.percentile("db", F.array(F.lit(0.05), F.lit(0.95))).alias("q"), ((F.max("t") - F.min("t")) / F.greatest(F.count("*") - 1, F.lit(1))).alias("step"))
    edge = edge.select(*keys, ((F.col("q")[0] + F.col("q")[1]) / 2).alias("thr"), F.greatest(F.lit(1), F.ceil(min_silence / F.nullif(F.col("step"), F.lit(0.0)))).alias("gap"))
    x = db.join(F.broadcast(edge), keys) if edge.limit(10_001).count() <= 10_000 else db.join(edge, keys)
    return windows.islands(x, [*keys, "gap"], ["frame", "t"], F.col("db") > F.col("thr"), min_gap=F.col("gap")).select(
        *keys, "island", F.col("first_t").alias("start"), F.col("last_t").alias("end"), "n_active"
    )


def fingerprints(peaks: DataFrame, least: int = 2, most: int = 40) -> DataFrame:
    """Pairs of peaks: path, channel, t (frame), dt, f1, f2."""
    x = sync.peak_pairs(peaks, ["path", "channel"], "frame", least, most, ["bin"])
    return x.select("path", "channel", "t", "dt", F.col("bin1").alias("f1"), F.col("bin2").alias("f2"))


def file_offset(a: DataFrame, b: DataFrame, radius: int = 2) -> DataFrame:
    """Frames by which the fingerprints of b come later than those of a: mode, delay, share of matches, n_matches."""
    x = checkpointed(a.select(F.lit(1).alias("one"), F.monotonically_increasing_id().alias("i"), "t", "dt", "f1", "f2"))
    y = b.select(F.lit(1).alias("one"), "dt", "f1", "f2", F.col("t").alias("t2"))
    near = sync.lattice_nearest(x, y, ["one"], ["dt", "f1", "f2"], radius, "i", "t2")
    m = near.join(x.select("i", "t"), "i").withColumn("delta", F.col("t2") - F.col("t"))
    return sync.offset_vote(m, ["one"], "delta").drop("one")


def find_chunk(blocks: DataFrame, chunk: np.ndarray) -> DataFrame:
    """Sample of each file and channel at which `chunk` is found, and the correlation there; blocks must overlap by its length."""
    ref = np.asarray(chunk, dtype=float)

    def run(batches):
        for g in batches:
            for b in g.itertuples(index=False):
                x = np.asarray(b.samples, dtype=float)
                if len(x) >= len(ref):
                    lag, c = correlation_delay(ref, x)
                    yield pd.DataFrame({"path": [b.path], "channel": [b.channel], "at": [round(b.t0 * b.rate) + lag], "correlation": [c]})

    found = blocks.mapInPandas(run, "path string, channel int, at long, correlation double")
    return found.groupBy("path", "channel").agg(F.max(F.struct("correlation", (-F.col("at")).alias("n"))).alias("m")).select("path", "channel", (-F.col("m.n")).alias("at"), "m.correlation")


def interesting_points(x: np.ndarray, rate: float, count: int = 2, apart: float = 1.0, hop_s: float = 0.1, size: int = 2048) -> np.ndarray:
    """Times of the loudest places at which the spectrum varies most, at least `apart` seconds from each other and the ends."""
    hop = max(1, int(hop_s * rate))
    db = 10 * np.log10(spectrogram(x, size, hop) + 1e-12)
    n = max(1, int(apart / hop_s))
    if len(db) <= 2 * n:
        return np.zeros(0)
    spread = np.lib.stride_tricks.sliding_window_view(db, n + 1, axis=0).std(axis=-1).sum(axis=1)
    varied = np.zeros(len(db))
    varied[n // 2 : n // 2 + len(spread)] = spread
    peaks = find_peaks(varied, distance=n)
    peaks = peaks[(peaks >= n) & (peaks < len(db) - n)]
    best = peaks[np.argsort(-db[peaks].sum(axis=1), kind="stable")][:count]
    return np.sort(best) * hop / rate


def chunk_delays(a: DataFrame, b: DataFrame, keys: list[str], size: int, count: int = 3) -> DataFrame:
    """Samples by which b comes later than a (audio blocks of the same keys), by the best of `count` chunks of a that are found in b.

    The chunks of `size` samples are those of the blocks of a that hold most energy; each is sought in every block of b, which
    must overlap by `size`. keys, delay, correlation (of 1 at most), n_chunks.
    """
    rate = F.col("rate")
    first = F.round(F.col("t0") * rate).cast("long")
    energy = F.aggregate("samples", F.lit(0.0), lambda s, x: s + x * x)
    chunks = a.filter(F.size("samples") >= size).select(*keys, first.alias("__at"), F.slice("samples", 1, size).alias("__chunk"), energy.alias("__e"))
    w = Window.partitionBy(*keys).orderBy(F.desc("__e"), "__at")
    chunks = chunks.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= count)
    pairs = b.filter(F.size("samples") >= size).select(*keys, first.alias("__first"), "samples").join(chunks, keys)

    def seek(chunk: pd.Series, samples: pd.Series) -> pd.DataFrame:
        out = []
        for c, x in zip(chunk, samples, strict=True):
            ref, x = np.asarray(c, dtype=float), np.asarray(x, dtype=float)
            ref = ref - ref.mean()
            n = 1 << (len(x) + len(ref)).bit_length()
            c = np.fft.irfft(np.conj(np.fft.rfft(ref, n)) * np.fft.rfft(x, n), n)[: len(x) - len(ref) + 1]
            own = np.lib.stride_tricks.sliding_window_view(x, len(ref))
            norm = np.sqrt(np.maximum((own * own).sum(axis=1) - own.mean(axis=1) ** 2 * len(ref), 0)) * np.sqrt((ref * ref).sum())
            r = np.where(norm > 1e-9, c / np.where(norm > 1e-9, norm, 1.0), 0.0)
            out.append((int(r.argmax()), float(r.max())))
        return pd.DataFrame(out, columns=["at", "correlation"])

    hit = pairs.withColumn("__m", F.pandas_udf(seek, "at long, correlation double")("__chunk", "samples"))
    delay = F.col("__first") + F.col("__m.at") - F.col("__at")
    best = hit.groupBy(*keys).agg(F.max(F.struct(F.round("__m.correlation", 9).alias("c"), (-F.abs(delay)).alias("near"), delay.alias("delay"))).alias("b"), F.countDistinct("__at").alias("n_chunks"))
    return best.select(*keys, F.col("b.delay").alias("delay"), F.col("b.c").alias("correlation"), "n_chunks")


def interesting_places(blocks: DataFrame, count: int = 2, apart: float = 1.0, hop_s: float = 0.1, size: int = 2048) -> DataFrame:
    """The `count` loudest places of each file and channel at which the spectrum varies most, in order of time: path, channel, t.

    The best places of each block are found by interesting_points, the best of all blocks by their level.
    """

    def run(batches):
        for g in batches:
            for b in g.itertuples(index=False):
                x = np.asarray(b.samples, dtype=float)
                t = interesting_points(x, b.rate, count, apart, hop_s, size)
                level = [float((x[int(s * b.rate) : int(s * b.rate) + size] ** 2).sum()) for s in t]
                yield pd.DataFrame({"path": b.path, "channel": b.channel, "t": t + b.t0, "level": level})

    found = blocks.mapInPandas(run, "path string, channel int, t double, level double")
    w = Window.partitionBy("path", "channel").orderBy(F.desc("level"), "t")
    return found.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= count).select("path", "channel", "t")
