"""Splits that keep related records together: grouped iterative stratification.

Records that share any of the given keys are related. Components of the relation are found by passing
the smallest key to neighbours until nothing changes; each key counts once however many records have
it. Their label vectors (records of each label) are aggregated. Components are placed with the rarest
outstanding label first, into the split that needs most of it (ties: most records needed, then the first).

Components of a LARGE-th of all records or more, of which there are at most LARGE, are placed first, in one
task. All others are hashed into shards of at most about SHARD components; each shard is placed against its
own share of what is still needed, rounded (where there are several) to whole records so that the shares of all shards add up: else a
label that is rare in every shard would always go to the split with the largest share.

A null key relates to nothing; a record without any key is a component of its own. Null labels are a
label. Copies of a record id are related by it. No records: no rows. Extra columns are left out.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from heapq import heapify, heappop, heappush

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ostinato.session import broadcast_if_small, checkpointed, parts_for

SPLITS = {"train": 0.8, "validation": 0.1, "test": 0.1}
LARGE = 2000
SHARD = 5000


def components(edges: DataFrame) -> DataFrame:
    """Component of each node of edges (a, b): node, component (its smallest node). Strings; nulls are left out.

    Each round every node takes the smallest label among its neighbours' and its own, and then that label's
    own label, so that long chains shorten by half.
    """
    both = edges.filter("a IS NOT NULL AND b IS NOT NULL").select("a", "b").distinct()
    both = checkpointed(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    label = checkpointed(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")))
    while True:
        near = both.join(label.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        step = label.join(near, "node", "left").select("node", F.col("component").alias("old"), F.least("component", F.coalesce("near", "component")).alias("component"))
        onward = label.select(F.col("node").alias("component"), F.col("component").alias("further"))
        step = checkpointed(step.join(onward, "component", "left").select("node", "old", F.least("component", F.coalesce("further", "component")).alias("component")))
        changed = step.filter("component <> old").limit(1).count()
        label = step.select("node", "component")
        if not changed:
            return label


def place(component: np.ndarray, label: np.ndarray, n: np.ndarray, size: np.ndarray, need: np.ndarray, total: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Split of each component. component, label, n: how many records of a label a component has, where it has any.

    size: all records of a component; need: records wanted of each label and split; total: records wanted of each
    split; order: a rank that decides between components of equal weight.
    """
    count, labels = len(size), len(need)
    need, total = need.astype(float).copy(), total.astype(float).copy()
    by_component = np.argsort(component, kind="stable")
    starts = np.searchsorted(component[by_component], np.arange(count + 1))
    by_label = np.lexsort((order[component], -size[component], -n, label))
    of_label = np.searchsorted(label[by_label], np.arange(labels + 1))
    outstanding = np.bincount(label, weights=n, minlength=labels)
    share = total / max(total.sum(), 1e-9)
    split = np.full(count, -1)
    rest = np.lexsort((order, -size)).tolist()  # for components without any label

    def put(i: int, wanted: np.ndarray, weight: float) -> list[int]:
        # What a label's share leaves open, not quite half a component up or down, goes to the splits that are behind overall.
        # Splits that hold their share already come last, however much of a label they lack.
        lead = wanted + np.clip(total - share * total.sum(), -0.45 * weight, 0.45 * weight)
        best = min(range(len(total)), key=lambda s: (total[s] < 0.5 * size[i], -lead[s], -total[s], s))
        split[i] = best
        mine = by_component[starts[i] : starts[i + 1]]
        need[label[mine], best] -= n[mine]
        total[best] -= size[i]
        outstanding[label[mine]] -= n[mine]
        return label[mine].tolist()

    heap = [(outstanding[j], j) for j in range(labels)]
    heapify(heap)
    while heap:
        left, j = heappop(heap)
        if left != outstanding[j] or left <= 0:
            continue  # an older figure of the label, or none of its records are left
        touched: set[int] = set()
        for k in by_label[of_label[j] : of_label[j + 1]].tolist():
            if split[component[k]] < 0:
                touched.update(put(int(component[k]), need[j], n[k]))
        for other in touched:
            heappush(heap, (outstanding[other], other))
    for i in rest:
        if split[i] < 0:
            put(i, total, 0.0)
    return split


def _apart(need: DataFrame) -> DataFrame:
    """need under other names than the components' it is cogrouped with."""
    return need.withColumnsRenamed({"shard": "part", "label": "of"}).select("*")


def split_records(records: DataFrame, key: str, related: Sequence[str], labels: Sequence[str], shares: Mapping[str, float] = SPLITS) -> DataFrame:
    """Split of each record: key, component, split. related: columns whose values tie records together."""
    names = list(shares)
    ratio = np.array([shares[n] for n in names]) / sum(shares.values())
    rows = records.select(
        F.col(key).alias("key"),
        F.concat(F.lit("key:"), F.col(key).cast("string")).alias("me"),
        F.array_compact(F.array(*[F.concat(F.lit(f"{c}:"), F.col(c).cast("string")) for c in related])).alias("ties"),
        F.array(*[F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in labels]).alias("labels"),
    )
    rows = rows.withColumn("anchor", F.coalesce(F.try_element_at("ties", F.lit(1)), "me", F.lit("key:")))
    # Keys are tied to the record's first key, and to its id where that has copies; a hub is one node, not a pair for each two records.
    ties = rows.select(F.col("anchor").alias("a"), F.explode(F.concat(F.col("ties"), F.array_compact(F.array("me")))).alias("b"))
    label = components(ties.filter("a <> b"))
    rows = checkpointed(rows.join(label, F.col("anchor") == F.col("node"), "left").select("key", F.coalesce("component", "anchor").alias("component"), "labels"))
    counted = rows.select("component", F.explode(F.concat("labels", F.array(F.lit("all")))).alias("label")).groupBy("component", "label").agg(F.count("*").alias("n"))
    counted = checkpointed(counted)
    totals = counted.groupBy("label").agg(F.sum("n").alias("total"))
    sized = counted.filter("label = 'all'").select("component", F.col("n").alias("size"))
    n_all = rows.count()
    n_small = sized.filter(F.col("size") * LARGE < n_all).count()
    shards = parts_for(n_small, SHARD, least=1)
    shard = F.when(F.col("size") * LARGE >= n_all, F.lit(-1).cast("long")).otherwise(F.pmod(F.xxhash64("component"), F.lit(shards)))
    vectors = counted.join(sized, "component").withColumn("shard", shard)

    def put(g: pd.DataFrame, need: pd.DataFrame) -> pd.DataFrame:
        if g.empty:
            return pd.DataFrame({"component": pd.Series([], dtype=object), "split": pd.Series([], dtype=object), "shard": pd.Series([], dtype="int64")})
        whole = g[g["label"] == "all"].reset_index(drop=True)
        at = pd.Series(whole.index, index=whole["component"])
        x = g[g["label"] != "all"]
        codes, known = pd.factorize(x["label"], sort=True)
        wanted = need.set_index("of")[names]
        rank = pd.util.hash_array(whole["component"].to_numpy(dtype=object)).argsort().argsort()
        got = place(
            at.reindex(x["component"]).to_numpy(), codes, x["n"].to_numpy(dtype=float), whole["n"].to_numpy(dtype=float),
            wanted.reindex(known).fillna(0).to_numpy(), wanted.loc["all"].to_numpy(), rank,
        )
        return pd.DataFrame({"component": whole["component"], "split": [names[i] for i in got], "shard": g["shard"].iloc[0]})

    placed_type = "component string, split string, shard long"
    all_need = totals.select(F.lit(-1).cast("long").alias("shard"), "label", *[(F.col("total") * float(r)).alias(n) for n, r in zip(names, ratio, strict=True)])
    large = checkpointed(vectors.filter("shard = -1").groupBy("shard").cogroup(_apart(all_need).groupBy("part")).applyInPandas(put, placed_type))
    # What the large components leave, shared among the shards by their records of each label.
    taken = vectors.join(broadcast_if_small(large.select("component", "split")), "component").groupBy("label").pivot("split", names).agg(F.sum("n"))
    taken = taken.select("label", *[F.coalesce(F.col(n), F.lit(0)).alias(f"taken_{n}") for n in names])
    small = vectors.filter("shard >= 0")
    left = small.groupBy("label").agg(F.sum("n").alias("left"))
    rest = all_need.drop("shard").join(left, "label").join(taken, "label", "left")
    mine = small.groupBy("shard", "label").agg(F.sum("n").alias("mine"))
    # Up to each shard, the records of a label are shared out as far as whole ones go; a shard gets what that adds.
    by_shard = Window.partitionBy("label").orderBy("shard")
    upto = F.sum("mine").over(by_shard.rowsBetween(Window.unboundedPreceding, 0))
    shard_need = mine.join(rest, "label").withColumn("upto", upto)
    # The largest split takes what the others leave; those step at different places, and at others for each label.
    largest = names[int(ratio.argmax())]
    others = [n for n in names if n != largest]
    needs = {}
    for i, n in enumerate(others, 1):
        due = (F.col(n) - F.coalesce(f"taken_{n}", F.lit(0))) / F.col("left")
        phase = F.pmod(F.pmod(F.xxhash64("label"), F.lit(1000)) / 1000 + i / (len(others) + 1), F.lit(1.0))
        step = lambda at: F.floor(at * due + phase)  # noqa: B023, E731
        whole = step(F.col("upto")) - step(F.col("upto") - F.col("mine"))
        needs[n] = (whole if shards > 1 else F.col("mine") * due).cast("double")
    needs[largest] = F.col("mine") - sum(needs.values(), F.lit(0.0))
    shard_need = shard_need.select("shard", "label", *[needs[n].alias(n) for n in names])
    rest_placed = small.groupBy("shard").cogroup(_apart(shard_need).groupBy("part")).applyInPandas(put, placed_type)
    placed = large.select("component", "split").unionByName(rest_placed.select("component", "split"))
    return rows.select("key", "component").join(placed, "component").select(F.col("key").alias(key), "component", "split")


def split_recordings(recordings: DataFrame, shares: Mapping[str, float] = SPLITS) -> DataFrame:
    """Splits of recordings: all of a subject and all listings of a file together, stratified by tune, instrument and channel set."""
    from ostinato.session import path_key

    rows = recordings.select("rec_id", path_key("filename").alias("file"), F.col("subject_id"), F.nullif(F.trim("tune"), F.lit("")).alias("tune"), F.lower(F.trim("instrument")).alias("instrument"), "channel_set")
    return split_records(rows, "rec_id", ["subject_id", "file"], ["tune", "instrument", "channel_set"], shares)
