"""Filling containers of fixed capacity: best-fit decreasing within shards.

An item over the capacity is divided into full pieces and a rest; no other item is. Items are hashed
into shards of about SHARD items, pieces counted. Within a shard they are taken from the largest to the smallest (ties by
key and piece), each into the open container with the least room that still holds it, found by a segment
tree over remaining capacities in logarithmic time. Containers of a shard are never shared with another,
which leaves at most a few part-filled ones in each shard.

Items of size 0 (null and empty texts) go into a container like any other. A null or negative size counts
as 0. Repeated rows and null keys are items of their own. No items: no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ostinato.session import checkpointed, parts_for

CAPACITY = 2048
SHARD = 20_000


class Room:
    """Open containers by remaining capacity, under a segment tree that finds the tightest one holding a size."""

    def __init__(self, capacity: int) -> None:
        self._leaves = 1 << capacity.bit_length()
        self._any = [0] * (2 * self._leaves)
        self._bins: dict[int, list[int]] = {}

    def put(self, room: int, container: int) -> None:
        self._bins.setdefault(room, []).append(container)
        i = room + self._leaves
        while i:
            self._any[i] += 1
            i >>= 1

    def take(self, size: int) -> tuple[int, int] | None:
        """The container with the least room that holds size, and its room; None if there is none."""
        i = size + self._leaves
        if not self._any[i]:
            while i > 1 and (i & 1 or not self._any[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self._leaves:
                i = 2 * i if self._any[2 * i] else 2 * i + 1
        room = i - self._leaves
        container = self._bins[room].pop()
        while i:
            self._any[i] -= 1
            i >>= 1
        return container, room


def best_fit(sizes: list[int], capacity: int) -> list[int]:
    """Container of each item, the items being taken in the order given; sizes are at most the capacity."""
    room, out, opened = Room(capacity), [], 0
    for size in sizes:
        found = room.take(size)
        if found is None:
            container, left = opened, capacity - size
            opened += 1
        else:
            container, left = found[0], found[1] - size
        out.append(container)
        room.put(left, container)
    return out


def pack(items: DataFrame, key: str, size: str, capacity: int = CAPACITY, shard: int = SHARD) -> DataFrame:
    """One row for each item or piece of one: key, piece, first, last (half-open, in units of size), n, container."""
    sized = checkpointed(items.select(F.col(key).cast("long").alias("key"), F.greatest(F.coalesce(F.col(size), F.lit(0)), F.lit(0)).cast("long").alias("size")))
    n_pieces = sized.agg(F.sum(F.greatest(F.ceil(F.col("size") / capacity), F.lit(1)))).first()[0] or 0
    shards = parts_for(n_pieces, shard, least=1)
    pieces = sized.select("key", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.greatest(F.col("size") - 1, F.lit(0)) / capacity))).alias("piece")).select(
        "key",
        "piece",
        (F.col("piece") * capacity).alias("first"),
        F.least(F.col("size"), (F.col("piece") + 1) * capacity).alias("last"),
        F.pmod(F.xxhash64("key", "piece"), F.lit(shards)).alias("shard"),
    )
    schema = pa.schema([("key", pa.int64()), ("piece", pa.int64()), ("first", pa.int64()), ("last", pa.int64()), ("n", pa.int64()), ("container", pa.int64())])

    def fill(t: pa.Table) -> pa.Table:
        g = t.to_pandas()
        g["n"] = g["last"] - g["first"]
        g = g.sort_values(["n", "key", "piece"], ascending=[False, True, True], kind="stable")
        g["container"] = g["shard"].to_numpy().astype(np.int64) * (1 << 32) + np.array(best_fit(g["n"].tolist(), capacity), dtype=np.int64)
        return pa.Table.from_pandas(g[schema.names], schema=schema, preserve_index=False)

    return pieces.groupBy("shard").applyInArrow(fill, "key long, piece long, first long, last long, n long, container long").withColumnRenamed("key", key)
