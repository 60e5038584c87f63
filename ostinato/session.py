"""Session helpers: table access, checkpoint folder, broadcast behind a size check."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes up to which a side is broadcast, as counted from its rows: fixed fields at 16 bytes, others at their length.
BROADCAST_BYTES = 64 << 20
#: Rows beyond which no side is looked at for its size.
BROADCAST_ROWS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder of spark.checkpoint.dir; only a local master may do without one and takes a temporary one."""
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isDefined():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="ostinato-checkpoint-"))


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder under the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """df written once, as Parquet, to the shared checkpoint folder: several readers don't compute it again, and read only the columns they need.

    The checkpoint folder is one of each application's own; tidy removes it.
    """
    folder = shared_folder(df.sparkSession, "step")
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def tidy(spark: SparkSession) -> None:
    """Remove what this application has written to its checkpoint folder; nothing that reads it may run any more."""
    folder = spark.sparkContext._jsc.sc().getCheckpointDir()
    if folder.isDefined():
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder.get())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(path)


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_ROWS, most: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if it has at most `limit` rows and `most` bytes; beyond that the join shuffles and AQE splits skewed keys."""
    fixed = [f.name for f in df.schema.fields if not isinstance(f.dataType, (T.StringType, T.BinaryType, T.ArrayType, T.StructType, T.MapType))]
    size = F.lit(16 * (len(fixed) + 1))
    for f in df.schema.fields:
        if f.name not in fixed:
            text = F.col(f"`{f.name}`") if isinstance(f.dataType, (T.StringType, T.BinaryType)) else F.to_json(F.struct(F.col(f"`{f.name}`")))
            size = size + F.coalesce(F.octet_length(text), F.lit(0)) + 16
    row = df.limit(limit + 1).agg(F.count("*").alias("n"), F.sum(size).alias("bytes")).first()
    return F.broadcast(df) if row["n"] <= limit and (row["bytes"] or 0) <= most else df


def parts_for(rows: int, rows_each: int, least: int = 8) -> int:
    """Number of hash buckets that holds about rows_each rows in each."""
    return max(least, -(-rows // rows_each))


def present(c) -> "F.Column":
    """Neither null nor NaN."""
    c = F.col(c) if isinstance(c, str) else c
    return c.isNotNull() & ~F.isnan(c)


def path_key(c) -> "F.Column":
    """A path as one key, however its separators, blanks and letter case are written."""
    c = F.col(c) if isinstance(c, str) else c
    return F.regexp_replace(F.lower(F.translate(c, "\\", "/")), r"\s+", "")
