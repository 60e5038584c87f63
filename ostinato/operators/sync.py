"""Synchronisation of recordings: peaks, fingerprints, votes on offsets, delays."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ostinato.functions.exprs import seconds
from ostinato.session import broadcast_if_small, path_key


def best_delays(delays: DataFrame) -> DataFrame:
    """The usable delay with the highest frac of each pair of files: video, signal, delay; of equal ones the smallest.

    delays: video_file, signal_file, video_to_signal_delay as typed, frac; a frac that is null or NaN comes last.
    """
    frac = F.coalesce(F.nanvl("frac", F.lit(-1.0)), F.lit(-1.0))
    return (
        delays.select(path_key("video_file").alias("video"), path_key("signal_file").alias("signal"), seconds("video_to_signal_delay").alias("delay"), frac.alias("frac"))
        .filter("video IS NOT NULL AND signal IS NOT NULL AND delay IS NOT NULL")
        .groupBy("video", "signal")
        .agg(F.max_by("delay", F.struct("frac", -F.col("delay"))).alias("delay"))
    )


def peak_pairs(peaks: DataFrame, keys: Sequence[str], t: str, least: float, most: float, carried: Sequence[str]) -> DataFrame:
    """Pairs of peaks of the same key, the second `least` to `most` after the first: keys, t, dt, carried of both (suffixes 1, 2).

    Peaks are joined by bucket of time as wide as `most`, each with its own bucket and the next.
    """
    a = peaks.select(*keys, F.col(t).alias("t"), *[F.col(c).alias(f"{c}1") for c in carried], F.explode(F.array(F.floor(F.col(t) / most), F.floor(F.col(t) / most) + 1)).alias("__b"))
    b = peaks.select(*keys, F.col(t).alias("__t2"), *[F.col(c).alias(f"{c}2") for c in carried], F.floor(F.col(t) / most).alias("__b"))
    gap = F.col("__t2") - F.col("t")
    return a.join(b, [*keys, "__b"]).filter((gap >= least) & (gap <= most)).withColumn("dt", gap).drop("__b", "__t2")


def lattice_neighbours(dims: int, radius: int) -> list[tuple[int, ...]]:
    """Integer vectors no longer than radius."""
    return [v for v in product(range(-radius, radius + 1), repeat=dims) if sum(x * x for x in v) <= radius * radius]


def lattice_nearest(left: DataFrame, right: DataFrame, keys: Sequence[str], dims: Sequence[str], radius: int, left_id: str, right_id: str) -> DataFrame:
    """Exact nearest right point of each left one among those of the same key within `radius` of it on an integer lattice.

    Each left point looks up the lattice points around it, so that the join is on equality. Ties: the smallest right_id.
    """
    around = F.array(*[F.struct(*[F.lit(x).alias(f"d{i}") for i, x in enumerate(v)]) for v in lattice_neighbours(len(dims), radius)])
    a = left.withColumn("__v", F.explode(around))
    square = sum((F.col(f"__v.d{i}") * F.col(f"__v.d{i}") for i in range(1, len(dims))), F.col("__v.d0") * F.col("__v.d0"))
    a = a.select(*keys, left_id, square.alias("square"), *[(F.col(c) + F.col(f"__v.d{i}")).alias(c) for i, c in enumerate(dims)])
    b = right.groupBy(*keys, *dims).agg(F.min(right_id).alias(right_id))
    hit = a.join(b, [*keys, *dims])
    return hit.groupBy(*keys, left_id).agg(F.min(F.struct("square", right_id)).alias("m")).select(*keys, left_id, F.col(f"m.{right_id}").alias(right_id), F.col("m.square").alias("square"))


#: Width of a block of fingerprints, or slots, of one key that are matched at a time.
BLOCK = 4096


def _pair_blocks(x: DataFrame, y: DataFrame, keys: Sequence[str], order: str, arrays: Sequence[str]) -> DataFrame:
    """Every block of rows of x with every block of y of the same key; a block is a row of arrays: what lies within BLOCK units of order.

    order is an integer and told apart within a key, so that a block holds at most BLOCK rows. A key with many rows makes
    many pairs of blocks, each a small piece of work, and no row of x meets a row of y in a join.
    """

    def value(c: str):
        return lambda s: s[c]

    def blocked(df: DataFrame, name: str) -> DataFrame:
        rows = F.array_sort(F.collect_list(F.struct(order, *[c for c in arrays if c != order])))
        g = df.groupBy(*keys, F.floor(F.col(order) / BLOCK).alias("__block")).agg(rows.alias("__rows"))
        return g.select(*keys, *[F.transform("__rows", value(c)).alias(f"{name}_{c}") for c in arrays])

    return blocked(x, "x").join(blocked(y, "y"), list(keys))


def offset_counts(x: DataFrame, y: DataFrame, keys: Sequence[str], features: Sequence[str], t: str) -> DataFrame:
    """How often rows of y come `delta` after rows of x with the same keys and features (integers), for every delta: keys, delta, n.

    Times of a feature are matched in blocks, and only counts leave them.
    """
    keys, both = list(keys), [*keys, *features]
    pairs = _pair_blocks(x, y, both, t, [t])
    types = ", ".join(f"`{k}` {x.schema[k].dataType.simpleString()}" for k in keys)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in batches:
            held: dict[tuple, dict[int, int]] = {}
            for row in g.itertuples(index=False):
                into = held.setdefault(tuple(getattr(row, k) for k in keys), {})
                a, b = np.asarray(getattr(row, f"x_{t}")), np.asarray(getattr(row, f"y_{t}"))
                for lo in range(0, len(a), 256):
                    delta, n = np.unique(b[None, :] - a[lo : lo + 256, None], return_counts=True)
                    for v, c in zip(delta.tolist(), n.tolist(), strict=True):
                        into[v] = into.get(v, 0) + c
            rows = [(*k, v, c) for k, into in held.items() for v, c in into.items()]
            yield pd.DataFrame(rows, columns=[*keys, "delta", "n"])

    found = pairs.select(*keys, f"x_{t}", f"y_{t}").mapInPandas(count, f"{types}, delta long, n long")
    return found.groupBy(*keys, "delta").agg(F.sum("n").alias("n"))


def offset_vote(matches: DataFrame, keys: Sequence[str], offset: str, tolerance: int = 2, count: str | None = None) -> DataFrame:
    """The most frequent offset (ties: the smallest), the mean of the offsets nearer to it than tolerance, and their share of all.

    count: the column that says how many matches a row stands for, 1 if there's none.
    """
    keys = list(keys)
    n = matches.groupBy(*keys, offset).agg((F.sum(count) if count else F.count("*")).alias("__n"))
    mode = n.groupBy(*keys).agg(F.max(F.struct("__n", (-F.col(offset)).alias("o"))).alias("__m"), F.sum("__n").alias("n_matches")).select(*keys, (-F.col("__m.o")).alias("mode"), "n_matches")
    near = n.join(mode, keys).filter(F.abs(F.col(offset) - F.col("mode")) < tolerance)
    return near.groupBy(*keys, "mode", "n_matches").agg((F.sum(F.col(offset) * F.col("__n")) / F.sum("__n")).alias("delay"), (F.sum("__n") / F.col("n_matches")).alias("share"))


def lag_correlation(x: DataFrame, y: DataFrame, keys: Sequence[str], digits: int = 6) -> DataFrame:
    """keys, lag, correlation, n: sum of products of x (keys, slot, v) and y at slot + lag, over the smaller number of slots, for every lag at which both have slots.

    Blocks of slots are correlated by Fourier transform; values count with `digits` decimals, so that sums don't depend on the order of blocks.
    """
    keys = list(keys)
    types = ", ".join(f"`{k}` {x.schema[k].dataType.simpleString()}" for k in keys)
    pairs = _pair_blocks(x, y, keys, "slot", ["slot", "v"])

    def spread(slots: np.ndarray, values: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
        first = int(slots.min())
        v, there = np.zeros(int(slots.max()) - first + 1), np.zeros(int(slots.max()) - first + 1)
        v[slots - first], there[slots - first] = values, 1.0
        return first, v, there

    def correlate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in batches:
            for row in g.itertuples(index=False):
                a0, a, a_there = spread(np.asarray(row.x_slot), np.asarray(row.x_v))
                b0, b, b_there = spread(np.asarray(row.y_slot), np.asarray(row.y_v))
                size = 1 << (len(a) + len(b) - 1).bit_length()
                turn = lambda p, q: np.fft.irfft(np.conj(np.fft.rfft(p, size)) * np.fft.rfft(q, size), size)  # noqa: B023, E731
                lag = np.arange(-(len(a) - 1), len(b))
                n = np.rint(turn(a_there, b_there)[lag]).astype(np.int64)
                c = turn(a, b)[lag]
                yield pd.DataFrame({**{k: getattr(row, k) for k in keys}, "lag": lag + (b0 - a0), "c": c, "n": n})[n > 0]

    found = pairs.mapInPandas(correlate, f"{types}, lag int, c double, n long")
    size = x.groupBy(*keys).agg(F.count("*").alias("__nx")).join(y.groupBy(*keys).agg(F.count("*").alias("__ny")), keys)
    total = F.sum(F.round("c", digits).cast(f"decimal(28,{digits})")).cast("double")
    g = found.groupBy(*keys, "lag").agg(total.alias("__c"), F.sum("n").alias("n")).join(size, keys)
    return g.select(*keys, "lag", (F.col("__c") / F.least("__nx", "__ny")).alias("correlation"), "n")


def best_lag(correlations: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The lag with the highest correlation (rounded to 5 digits; ties: the smallest)."""
    w = Window.partitionBy(*keys).orderBy(F.desc(F.round("correlation", 5)), F.abs("lag"), "lag")
    return correlations.withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r")


def contained_names(texts: DataFrame, names: DataFrame, text: str, name: str, order: str) -> DataFrame:
    """The first name (by `order`) that each text holds: the columns of texts, with name; texts that hold none are left out.

    Texts are cut into pieces of the lengths that names have, so that the join is on equality and grows with the texts;
    names are a list whose lengths are few.
    """
    listed = names.filter(F.length(name) > 0).groupBy(name).agg(F.min(order).alias("__order"))
    lengths = sorted(r[0] for r in listed.select(F.length(name)).distinct().collect())
    if not lengths:
        return texts.withColumn(name, F.lit(None).cast("string")).limit(0)
    cut = lambda n: F.when(F.length(text) >= n, F.transform(F.sequence(F.lit(1), F.length(text) - (n - 1)), lambda i: F.substr(F.col(text), i, F.lit(n))))
    distinct = texts.select(text).distinct()
    pieces = distinct.select(text, F.explode(F.array_distinct(F.flatten(F.array_compact(F.array(*[cut(n) for n in lengths]))))).alias(name))
    best = pieces.join(broadcast_if_small(listed), name).groupBy(text).agg(F.min(F.struct("__order", name)).alias("__m")).select(text, F.col(f"__m.{name}").alias(name))
    return texts.join(best, text)
