"""Tables written in the folder that all executors share, where a plan is cut so that it is computed once."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BROADCAST_BYTES = 32 << 20


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path under ``spark.checkpoint.dir``; only on a local master, where that is unset, under a local folder."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="quill-"))
    return f"{context.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Writes ``df`` as Parquet and returns it reread: several uses compute it once, also when executors are lost."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fits(df: DataFrame, most: int = BROADCAST_BYTES) -> bool:
    """Whether the strings of ``df``, a cut or cheap table of strings and numbers, and 16 bytes a column are at most ``most``."""
    size = F.lit(16 * len(df.columns))
    for name, kind in df.dtypes:
        if kind == "string":
            size = size + F.coalesce(F.octet_length(name), F.lit(0))
    return df.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0] <= most


def if_small(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """``df``, to be broadcast if it ``fits``."""
    return F.broadcast(df) if fits(df, most) else df


def in_all_cores(df: DataFrame) -> DataFrame:
    """``df``, a table as it is read, spread over the cores if its files give fewer splits than there are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def with_ordinals(rows: DataFrame, splits: list[str], at: str, name: str) -> DataFrame:
    """Adds dense ids from 0 to a cut table in the order of ``splits`` and ``at``, numbers from monotonically_increasing_id
    without gaps in a split. Only the splits' sizes, one row each, are added up in one task; no other row is moved."""
    sizes = rows.groupBy(*splits).agg(F.count("*").alias("_size"), F.min(at).alias("_first"))
    before = Window.orderBy(*splits).rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(*splits, (F.coalesce(F.sum("_size").over(before), F.lit(0)) - F.col("_first")).alias("_base"))
    return rows.join(F.broadcast(sizes), splits).withColumn(name, (F.col("_base") + F.col(at)).cast("long")).drop("_base")
