"""Sequential operators, many whole groups at a time.

Rows are hashed by their keys and sorted, and pass to Python as a stream of Arrow batches: what is held there is a
batch and the group it ends in, however many groups there are. A group by itself must be of bounded size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def _same(a: pd.DataFrame, b: pd.DataFrame) -> np.ndarray:
    """Which rows of a equal those of b; nulls equal nulls."""
    out = np.ones(len(a), dtype=bool)
    for k in a.columns:
        x, y = a[k].to_numpy(), b[k].to_numpy()
        out &= np.asarray((x == y) | (pd.isna(x) & pd.isna(y)), dtype=bool)
    return out


def whole_groups(batches: Iterator[pd.DataFrame], keys: Sequence[str]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Frames that hold only whole groups of sorted rows, and where each group starts in them."""
    keys = list(keys)
    held: list[pd.DataFrame] = []  # rows of the group that may go on
    for g in batches:
        if g.empty:
            continue
        new = np.ones(len(g), dtype=bool)
        new[1:] = ~_same(g[keys].iloc[1:], g[keys].iloc[:-1])
        if held:
            new[0] = not _same(g[keys].iloc[:1], held[0][keys].iloc[:1])[0]
        starts = np.flatnonzero(new)
        if not len(starts):
            held.append(g)
            continue
        done = [*held, g.iloc[: starts[-1]]] if held or starts[-1] else []
        if done:
            before = sum(len(h) for h in held)
            ready = pd.concat(done, ignore_index=True)
            first = starts[:-1] + before
            yield ready, np.concatenate([[0], first]) if before else first
        held = [g.iloc[starts[-1] :]]
    if held:
        yield pd.concat(held, ignore_index=True), np.zeros(1, dtype=np.int64)


def streamed(df: DataFrame, keys: Sequence[str], run: Callable[[pd.DataFrame, np.ndarray], pd.DataFrame], schema: str, order: Sequence[str] = ()) -> DataFrame:
    """run(frame of whole groups, where each starts) over all rows, sorted by keys and order; schema: of its result."""
    keys = list(keys)
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame, starts in whole_groups(batches, keys):
            yield run(frame, starts)

    # The number is given, as AQE would join the few bytes of work that takes long.
    return df.repartition(parts, *keys).sortWithinPartitions(*keys, *order).mapInPandas(stream, schema)


def per_group(df: DataFrame, keys: Sequence[str], run: Callable[[pd.DataFrame], pd.DataFrame], schema: str, order: Sequence[str] = ()) -> DataFrame:
    """run(rows of a group) for each group; its result gets the keys in front. schema: of the result without the keys."""
    keys = list(keys)
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    full = ", ".join([*(f"`{k}` {types[k]}" for k in keys), schema])
    names = [c.strip().split(" ")[0].strip("`") for c in schema.split(",")]

    def each(frame: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
        out = []
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(frame)], strict=True):
            rows = frame.iloc[a:b].reset_index(drop=True)
            got = run(rows)
            if len(got):
                for i, k in enumerate(keys):
                    got.insert(i, k, rows[k].iloc[0])
                out.append(got)
        return pd.concat(out, ignore_index=True)[[*keys, *names]] if out else frame.iloc[:0].reindex(columns=[*keys, *names])

    return streamed(df, keys, each, full, order)
