"""Descriptors of sampled signals: framing, envelope, fundamental, spectrum, harmonics, delay."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def frames(x: np.ndarray, size: int, hop: int) -> np.ndarray:
    """Full frames of `size` samples every `hop` samples."""
    if len(x) < size:
        return np.zeros((0, size))
    return np.lib.stride_tricks.sliding_window_view(x, size)[::hop]


def rms(x: np.ndarray, size: int, hop: int, window=np.blackman) -> np.ndarray:
    """Root of the mean square of each frame, its mean removed, weighted by the window."""
    f, w = frames(np.asarray(x, dtype=float), size, hop), window(size)
    y = (f - f.mean(axis=1, keepdims=True)) * w
    return np.sqrt((y * y).sum(axis=1) / (w * w).sum())


def centroid(x: np.ndarray, rate: float, size: int, hop: int) -> np.ndarray:
    """Spectral centroid of each frame in Hz; NaN where there's no sound."""
    spectrum = np.abs(np.fft.rfft(frames(np.asarray(x, dtype=float), size, hop) * np.hanning(size), axis=1))
    total = spectrum.sum(axis=1)
    with np.errstate(invalid="ignore", divide="ignore"):
        return (spectrum * np.fft.rfftfreq(size, 1 / rate)).sum(axis=1) / np.where(total > 0, total, np.nan)


def yin(x: np.ndarray, rate: float, size: int, hop: int, fmin: float, fmax: float, threshold: float = 0.1) -> np.ndarray:
    """Fundamental of each frame by the cumulative mean normalised difference (de Cheveigné and Kawahara 2002); NaN for silence."""
    f = frames(np.asarray(x, dtype=float), size, hop)
    longest = min(int(rate / fmin) + 2, size // 2)
    shortest = max(1, int(rate / fmax))
    n = size - longest
    difference = np.zeros((len(f), longest))
    for lag in range(1, longest):
        d = f[:, :n] - f[:, lag : lag + n]
        difference[:, lag] = (d * d).sum(axis=1)
    with np.errstate(invalid="ignore", divide="ignore"):
        mean = np.cumsum(difference[:, 1:], axis=1) / np.arange(1, longest)
        normal = np.where(mean > 0, difference[:, 1:] / mean, 1.0)
    normal = np.concatenate([np.ones((len(f), 1)), normal], axis=1)
    out = np.full(len(f), np.nan)
    for i, row in enumerate(normal):
        dips = np.flatnonzero((row[shortest:-1] < threshold) & (row[shortest:-1] <= row[shortest + 1 :])) + shortest
        lag = int(dips[0]) if len(dips) else int(row[shortest:].argmin()) + shortest
        if not difference[i].any():
            continue
        shift = 0.0
        if 0 < lag < longest - 1:
            a, b, c = row[lag - 1 : lag + 2]
            if a - 2 * b + c > 0:
                shift = 0.5 * (a - c) / (a - 2 * b + c)
        out[i] = rate / (lag + shift)
    return out


def low_pass(x: np.ndarray, size: int) -> np.ndarray:
    """One value for every `size` samples, by cutting the spectrum."""
    x = np.asarray(x, dtype=float)
    n = len(x) // size
    if n == 0:
        return np.zeros(0)
    spectrum = np.fft.rfft(x)[: n // 2 + 1]
    return np.fft.irfft(spectrum, n) * n / len(x)


def harmonics(x: np.ndarray, rate: float, f0: np.ndarray, size: int, hop: int, count: int) -> np.ndarray:
    """Complex amplitude of the first `count` harmonics of f0 in each frame (rows: frames)."""
    f = frames(np.asarray(x, dtype=float), size, hop) * np.hanning(size)
    t = np.arange(size) / rate
    f0 = np.resize(np.nan_to_num(f0), len(f))
    turn = np.exp(-2j * np.pi * f0[:, None, None] * np.arange(1, count + 1)[None, :, None] * t[None, None, :])
    return 2 * (f[:, None, :] * turn).sum(axis=2) / np.hanning(size).sum()


def correlation_delay(x: np.ndarray, y: np.ndarray) -> tuple[int, float]:
    """Lag at which y resembles x most (y[i + lag] ~ x[i]) and the correlation there for each sample."""
    size = 1 << int(np.ceil(np.log2(max(1, len(x) + len(y)))))
    c = np.fft.irfft(np.conj(np.fft.rfft(x, size)) * np.fft.rfft(y, size), size)
    at = int(c.argmax())
    return at - size if at > size // 2 else at, float(c[at]) / max(1, min(len(x), len(y)))


def _last_above(x: np.ndarray, places: np.ndarray) -> np.ndarray:
    """For each place (ascending) the last one before it with a higher value, -1 if there is none: a stack of falling values."""
    out, stack, at = np.full(len(places), -1), [], 0
    for n, p in enumerate(places.tolist()):
        for i in range(at, p):
            v = x[i]
            while stack and x[stack[-1]] <= v:
                stack.pop()
            stack.append(i)
        at = p
        while stack and x[stack[-1]] <= x[p]:
            stack.pop()
        out[n] = stack[-1] if stack else -1
    return out


def prominences(x: np.ndarray, peaks: np.ndarray) -> np.ndarray:
    """Height of each peak above the higher of the two lowest values on the way to higher ground, or the end, on either side."""
    if not len(peaks):
        return np.zeros(0)
    values = x.tolist()
    left = _last_above(values, peaks) + 1
    right = len(x) - 1 - (_last_above(values[::-1], len(x) - 1 - peaks[::-1])[::-1] + 1)
    low = np.minimum.reduceat(np.append(x, np.inf), np.stack([left, peaks + 1], axis=1).ravel())[::2]
    high = np.minimum.reduceat(np.append(x, np.inf), np.stack([peaks, right + 1], axis=1).ravel())[::2]
    return x[peaks] - np.maximum(low, high)


def find_peaks(x: np.ndarray, prominence: float = 0.0, distance: int = 1, height: float = -np.inf, most: float = np.inf) -> np.ndarray:
    """Places higher than both neighbours (middle of a flat top), by height (and at most `most`), then distance (highest first), then prominence."""
    x = np.asarray(x, dtype=float)
    if len(x) < 3:
        return np.zeros(0, dtype=int)
    first = np.flatnonzero(np.append(True, x[1:] != x[:-1]))  # starts of flat stretches
    last = np.append(first[1:], len(x)) - 1
    v = x[first]
    top = np.zeros(len(v), dtype=bool)
    top[1:-1] = (v[1:-1] > v[:-2]) & (v[1:-1] > v[2:])
    peaks = ((first + last) // 2)[top]
    peaks = peaks[(x[peaks] >= height) & (x[peaks] <= most)]
    if distance > 1:
        free = np.ones(len(peaks), dtype=bool)
        kept = np.zeros(len(peaks), dtype=bool)
        for i in np.lexsort((peaks, -x[peaks])).tolist():
            if free[i]:
                kept[i] = True
                free[np.searchsorted(peaks, peaks[i] - distance, side="right") : np.searchsorted(peaks, peaks[i] + distance)] = False
        peaks = peaks[kept]
    return peaks[prominences(x, peaks) >= prominence] if prominence > 0 else peaks


def frame_centroid(samples: str) -> Column:
    """Centre of the amplitude spectrum, in bins, of a column of arrays of samples."""

    def run(s: pd.Series) -> pd.Series:
        out = []
        for v in s:
            a = np.abs(np.fft.rfft(np.asarray(v, dtype=float)))
            out.append(float((a * np.arange(len(a))).sum() / a.sum()) if a.sum() > 0 else None)
        return pd.Series(out, dtype="float64")

    return F.pandas_udf(run, "double")(samples)


def frame_yin(samples: str, rate: Column, fmin: float, fmax: float) -> Column:
    """Fundamental of each array of samples taken at `rate`."""

    def run(s: pd.Series, r: pd.Series) -> pd.Series:
        return pd.Series([float(yin(np.asarray(v), x, len(v), len(v), fmin, fmax)[0]) if len(v) > 3 else None for v, x in zip(s, r, strict=True)], dtype="float64")

    return F.pandas_udf(run, "double")(samples, rate)


def frame_low_pass(samples: Column, size: int) -> Column:
    """One value for every `size` samples of a column of arrays, by cutting the spectrum."""

    def run(s: pd.Series) -> pd.Series:
        return pd.Series([low_pass(np.asarray(v, dtype=float), size) for v in s])

    return F.pandas_udf(run, "array<double>")(samples)


def frame_harmonics(df: DataFrame, keys: list[str], place: str, v: str, size: int, count: int) -> DataFrame:
    """Complex amplitude (re, im) of the first `count` harmonics k of a frame of `size` samples, rows of df: keys, k, re, im."""
    out = []
    for k in range(1, count + 1):
        turn = 2 * np.pi * k * F.col(place) / size
        out += [(F.sum(F.col(v) * F.cos(turn)) * (2.0 / size)).alias(f"re_{k}"), (F.sum(F.col(v) * F.sin(turn)) * (-2.0 / size)).alias(f"im_{k}")]
    g = df.groupBy(*keys).agg(*out)
    return g.select(*keys, F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"re_{k}").alias("re"), F.col(f"im_{k}").alias("im")) for k in range(1, count + 1)])).alias("h")).select(*keys, "h.*")


def heterodyne(df: DataFrame, keys: list[str], t: str, v: str, hz: list[float]) -> DataFrame:
    """Complex amplitude (re_i, im_i) of each frequency within each group, by multiplication with it and averaging."""
    out = []
    for i, f in enumerate(hz, 1):
        turn = 2 * np.pi * f * F.col(t)
        out += [(2 * F.avg(F.col(v) * F.cos(turn))).alias(f"re_{i}"), (-2 * F.avg(F.col(v) * F.sin(turn))).alias(f"im_{i}")]
    return df.groupBy(*keys).agg(*out)


def window_percentiles(x: np.ndarray, size: int, hop: int, at=(5, 25, 50, 75, 95), window=np.hanning) -> np.ndarray:
    """Weighted percentiles of each frame (rows), weights by the window, values at the middle of their weight."""
    f = frames(np.asarray(x, dtype=float), size, hop)
    w = np.broadcast_to(window(size + 2)[1:-1], f.shape)
    by = np.argsort(f, axis=1, kind="stable")
    v, w = np.take_along_axis(f, by, axis=1), np.take_along_axis(w, by, axis=1)
    place = (np.cumsum(w, axis=1) - w / 2) / w.sum(axis=1, keepdims=True) if len(f) else w
    return np.array([np.interp(np.array(at) / 100, p, y) for p, y in zip(place, v, strict=True)]).reshape(len(f), len(at))


def relative_phase(h: np.ndarray) -> np.ndarray:
    """Phase of each harmonic (columns) less what the first one's phase gives it, within half a turn."""
    order = np.arange(1, h.shape[1] + 1)
    return (np.angle(h) - order * np.angle(h[:, :1]) + np.pi) % (2 * np.pi) - np.pi


def moment_frequency(h: np.ndarray, f0: np.ndarray, step: float) -> np.ndarray:
    """Frequency of each harmonic (columns) between neighbouring frames `step` seconds apart, from how its phase goes on beyond k * f0."""
    order = np.arange(1, h.shape[1] + 1)
    f = (f0[1:, None] + f0[:-1, None]) / 2 * order
    turn = np.angle(h[1:]) - np.angle(h[:-1])
    extra = (turn - 2 * np.pi * f * step + np.pi) % (2 * np.pi) - np.pi
    return f + extra / (2 * np.pi * step)


def describe(blocks: DataFrame, size: int = 1024, hop: int = 512, fmin: float = 60.0, fmax: float = 1500.0, count: int = 5) -> DataFrame:
    """Series of each channel of audio blocks (path, channel, block, t0, rate, samples, own): path, channel, descriptor, t, v, v_im.

    ampl, f0, centr; dc, the slow part; p05 to p95, weighted percentiles; h01 to h0n, complex amplitudes of harmonics, with their
    relative phase (_rarg) and frequency of the moment (_freq). Blocks overlap, so that no frame is lost at an edge (by size
    and hop, for the frequency of the moment goes on to the next frame); frames that start in the first `own` samples belong to a block.
    """
    at = (5, 25, 50, 75, 95)

    def run(batches):
        for g in batches:
            for b in g.itertuples(index=False):
                x = np.asarray(b.samples, dtype=float)
                starts = np.arange(0, max(0, len(x) - size + 1), hop)
                mine = starts < b.own
                t = b.t0 + (starts + size / 2) / b.rate
                f0 = yin(x, b.rate, size, hop, fmin, fmax)
                series = {"ampl": rms(x, size, hop), "f0": f0, "centr": centroid(x, b.rate, size, hop)}
                q = window_percentiles(x, size, hop, at)
                series |= {f"p{p:02d}": q[:, i] for i, p in enumerate(at)}
                series["dc"] = np.array([low_pass(f, size)[0] for f in frames(x, size, hop)])
                h = harmonics(x, b.rate, f0, size, hop, count)
                phase = relative_phase(h)
                moment = np.full(phase.shape, np.nan)
                if len(h) > 1:
                    moment[:-1] = moment_frequency(h, np.nan_to_num(f0), hop / b.rate)
                for k in range(h.shape[1]):
                    series |= {f"h{k + 1:02d}": h[:, k], f"h{k + 1:02d}_rarg": phase[:, k], f"h{k + 1:02d}_freq": moment[:, k]}
                for name, v in series.items():
                    v = v[: len(mine)][mine]
                    yield pd.DataFrame({"path": b.path, "channel": b.channel, "descriptor": name, "t": t[mine], "v": np.real(v), "v_im": np.imag(v) if np.iscomplexobj(v) else None})

    return blocks.mapInPandas(run, "path string, channel int, descriptor string, t double, v double, v_im double")
