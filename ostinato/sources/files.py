"""Files of any kind, one row each: written by the tasks that hold them, through Arrow's file systems (local, HDFS, object stores)."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _file_system(folder: str):
    from pyarrow import fs

    if "://" not in folder:
        folder = "file://" + folder.removeprefix("file:")
    return fs.FileSystem.from_uri(folder)


def write_files(files: DataFrame, folder: str) -> int:
    """Write content (text or binary) of each row to the file `name` in a folder that all executors share; how many there are.

    A file is written beside its place and moved there, so that a task that is run again replaces what it wrote.
    """

    def put(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, root = _file_system(folder)
        system.create_dir(root, recursive=True)
        for g in batches:
            for name, content in zip(g["name"], g["content"], strict=True):
                part = f"{root}/.{uuid.uuid4().hex}"
                with system.open_output_stream(part) as out:
                    out.write(bytes(content))
                system.move(part, f"{root}/{name}")
            yield pd.DataFrame({"n": [len(g)]})

    whole = files.select("name", F.col("content").cast("binary").alias("content")).filter("name IS NOT NULL AND content IS NOT NULL")
    return int(whole.mapInPandas(put, "n long").agg(F.sum("n")).first()[0] or 0)


def file_name(path) -> "F.Column":
    """A path as the name of one file."""
    c = F.col(path) if isinstance(path, str) else path
    return F.regexp_replace(F.regexp_replace(c, r"[^A-Za-z0-9_.-]+", "_"), "^_+", "")
