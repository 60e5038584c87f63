"""Interval annotations in text grids: reading trees of files, picking tiers, writing."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ostinato.sources.files import file_name, write_files

INTERVALS = "path string, tier_nbr int, tier string, idx int, start double, end double, label string"
_TIER = re.compile(r'class\s*=\s*"IntervalTier"\s*name\s*=\s*"((?:[^"]|"")*)"')
_INTERVAL = re.compile(r'xmin\s*=\s*([-+.\deE]+)\s*xmax\s*=\s*([-+.\deE]+)\s*text\s*=\s*"((?:[^"]|"")*)"')


def parse(text: str) -> Iterator[tuple[int, str, int, float, float, str]]:
    """(place of the tier, tier, number from 0, start, end, label) of each labelled interval of a long text grid."""
    heads = list(_TIER.finditer(text))
    for n, (head, following) in enumerate(zip(heads, [*heads[1:], None], strict=True)):
        part = text[head.end() : following.start() if following else len(text)]
        body = part[part.find("intervals") :]
        i = 0
        for m in _INTERVAL.finditer(body):
            label = m.group(3).replace('""', '"')
            if label.strip():
                yield n, head.group(1).replace('""', '"'), i, float(m.group(1)), float(m.group(2)), label
                i += 1


def render(tiers: dict[str, list[tuple[float, float, str]]], length: float) -> str:
    """A long text grid of the given tiers; gaps between intervals are empty intervals."""
    out = ['File type = "ooTextFile"', 'Object class = "TextGrid"', "", "xmin = 0", f"xmax = {length}", "tiers? <exists>", f"size = {len(tiers)}", "item []:"]
    for n, (name, spans) in enumerate(tiers.items(), 1):
        full, at = [], 0.0
        for start, end, label in sorted(spans):
            if start > at:
                full.append((at, start, ""))
            full.append((start, end, label))
            at = max(at, end)
        if at < length:
            full.append((at, length, ""))
        quoted = name.replace('"', '""')
        out += [f"    item [{n}]:", '        class = "IntervalTier"', f'        name = "{quoted}"', "        xmin = 0", f"        xmax = {length}", f"        intervals: size = {len(full)}"]
        for i, (start, end, label) in enumerate(full, 1):
            text = label.replace('"', '""')
            out += [f"        intervals [{i}]:", f"            xmin = {start}", f"            xmax = {end}", f'            text = "{text}"']
    return "\n".join(out) + "\n"


def read_intervals(spark: SparkSession, path: str) -> DataFrame:
    """Labelled intervals of all text grids under path; UTF-8, or UTF-16 with a mark."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.TextGrid").option("recursiveFileLookup", "true").load(path)

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in batches:
            for name, content in zip(g["path"], g["content"], strict=True):
                text = content.decode("utf-16" if content[:2] in (b"\xff\xfe", b"\xfe\xff") else "utf-8-sig", errors="replace")
                rows = [(name, *r) for r in parse(text)]
                if rows:
                    yield pd.DataFrame(rows, columns=["path", "tier_nbr", "tier", "idx", "start", "end", "label"])

    return files.select("path", "content").mapInPandas(run, INTERVALS)


def pick_tier(intervals: DataFrame, prefix: str) -> DataFrame:
    """Intervals of the first tier of each file that starts with prefix."""
    t = intervals.filter(F.lower("tier").startswith(prefix)).groupBy("path").agg(F.min("tier_nbr").alias("tier_nbr"))
    return intervals.join(t, ["path", "tier_nbr"], "left_semi")


def first_label_region(intervals: DataFrame, pattern: str, nth: int = 0) -> DataFrame:
    """The nth interval (from 0) of each file whose label begins with the pattern."""
    w = F.row_number().over(_by_path())
    hit = intervals.filter(F.col("label").rlike("^(?:" + pattern + ")"))
    return hit.withColumn("__n", w).filter(F.col("__n") == nth + 1).drop("__n")


def _by_path():
    from pyspark.sql import Window

    return Window.partitionBy("path").orderBy("start", "tier", "idx")


def default_label(tier: str, idx: str, label: str) -> Column:
    """The label, or tier and number where there's none."""
    return F.coalesce(F.nullif(F.trim(label), F.lit("")), F.format_string("%s %d", F.col(tier), F.col(idx)))


def as_texts(intervals: DataFrame) -> DataFrame:
    """path and text grid of the intervals (path, tier, start, end, label) of each file."""
    from ostinato.operators.grouped import per_group

    def run(g: pd.DataFrame) -> pd.DataFrame:
        tiers = {t: list(x[["start", "end", "label"]].itertuples(index=False, name=None)) for t, x in g.groupby("tier", sort=True)}
        return pd.DataFrame({"text": [render(tiers, float(g["end"].max()))]})

    return per_group(intervals.select("path", "tier", "start", "end", "label"), ["path"], run, "text string")


def write_texts(texts: DataFrame, folder: str, extension: str = ".TextGrid") -> int:
    """Write one file for each row (path, text), named after the path, into a folder that all executors share."""
    return write_files(texts.select(F.concat(file_name("path"), F.lit(extension)).alias("name"), F.col("text").alias("content")), folder)
