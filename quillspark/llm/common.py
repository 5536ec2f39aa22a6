"""What the training-data operators share: shared storage, lineage cuts, link components."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import tempfile
import uuid
import weakref
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BITMAP_BITS = 1 << 24
BUCKET_BITS = 32768  # of Spark's bitmap functions


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: the session's ``spark.checkpoint.dir``.

    Only on a local master, where that is unset (tests, a laptop), is a local folder made."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="quill-"))
    return context.getCheckpointDir()


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder, which is deleted when this program ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _written.append((weakref.ref(spark), path))
    return path


_written: list[tuple[weakref.ref, str]] = []


@atexit.register
def _delete_written() -> None:
    """Tables cut here are read by whatever was built on them, as long as this program runs; then they go."""
    for reference, path in _written:
        spark = reference()
        try:
            if spark is not None and spark.sparkContext._jsc is not None:
                target = spark._jvm.org.apache.hadoop.fs.Path(path)
                target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # noqa: BLE001 - the session is gone, or the folder with it
            return


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Writes ``df`` as Parquet in the shared folder and returns it reread: later jobs start here,
    also when executors are lost."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def arrow_batches(spark: SparkSession, size: str) -> Iterator[None]:
    """Tables cut in this context go to Python in batches of ``size`` instead of the session's (64 MB, held by either side)."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, size)
    try:
        yield
    finally:
        spark.conf.set(name, before)


held_by_worker: list[Callable[[], None]] = []  # what forgets tables that an operator keeps between tasks


def free_memory() -> None:
    """Gives back what this Python worker keeps: operators' tables, and what was freed but not returned to the system."""
    for forget in held_by_worker:
        forget()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # not the C library of GNU
        ctypes.CDLL(None).malloc_trim(0)


BROADCAST_ROWS = 1_000_000


def if_small(keys: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``keys``, a cut table of fixed-width columns, to be broadcast if it has at most ``rows`` rows; a larger
    one is joined by shuffle."""
    return F.broadcast(keys) if keys.count() <= rows else keys


def packed(rows: DataFrame, **columns: Column) -> DataFrame:
    """``_row``, a struct of all columns, beside new ones: no name can clash with a column of ``rows``."""
    return rows.select(F.struct("*").alias("_row"), *(c.alias(name) for name, c in columns.items()))


def salt(rows: DataFrame, by: Column, n: int, name: str = "_salt") -> DataFrame:
    return rows.withColumn(name, F.pmod(F.xxhash64(by), F.lit(n)).cast("int"))


def spread(keyed: DataFrame, n: int, name: str = "_salt") -> DataFrame:
    """A copy of every row of a table with unique keys for each salt."""
    return keyed.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


def key_bitmap(keys: DataFrame, column: str) -> bytes:
    """A bitmap of ``BITMAP_BITS`` bits, its proven size, with the CRC-32 of every key's string set.

    It passes all of the keys and few others; what it passes is joined exactly afterwards."""
    place = F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(BITMAP_BITS))
    parts = (
        keys.select(place.alias("place"))
        .groupBy(F.floor(F.col("place") / BUCKET_BITS).cast("int").alias("bucket"))
        .agg(F.bitmap_construct_agg(F.pmod("place", F.lit(BUCKET_BITS)).cast("long")).alias("bits"))
        .collect()  # at most BITMAP_BITS / BUCKET_BITS rows of 4 KB
    )
    bitmap = bytearray(BITMAP_BITS // 8)
    for part in parts:
        bitmap[part["bucket"] * BUCKET_BITS // 8 : (part["bucket"] + 1) * BUCKET_BITS // 8] = part["bits"]
    return bytes(bitmap)


def in_bitmap(bitmap: bytes, key: str) -> int:
    place = zlib.crc32(key.encode("utf-8", "surrogatepass")) & (BITMAP_BITS - 1)
    return bitmap[place >> 3] >> (place & 7) & 1


SALTS = 8


def salted_join(rows: DataFrame, keyed: DataFrame, key: str, by: Column, how: str = "inner", n: int = SALTS, few: bool | None = None) -> DataFrame:
    """``rows`` joined with the unique keys of ``keyed``, of fixed width: broadcast if they are few (counted if not told), else
    copied for each salt, so that the rows of a hot key are spread over ``n`` tasks. A null key joins with nothing and is spread
    as well."""
    if keyed.count() <= BROADCAST_ROWS if few is None else few:
        return rows.join(F.broadcast(keyed), key, how)
    return salt(rows, by, n).join(spread(keyed, n), [key, "_salt"], how).drop("_salt")


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges(a, b)`` (long, any direction): ``(id, component)`` with the
    smallest id of each component, for ids that have an edge.

    Alternating large-star and small-star rounds until nothing changes, which they do after about the
    logarithm of the longest path. Each round is a grouped minimum, which is partial, and a join of the
    edges with it, which is salted by the other end, so a hub is never gathered in one task; every round
    is cut in the shared folder."""
    near = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    previous, n = None, near.count()
    while True:
        few = 2 * n <= BROADCAST_ROWS  # ids
        both = near.unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = salted_join(both.where("b > a"), low, "a", F.col("b"), few=few).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = large.unionByName(low.where("m < a").select("a", F.col("m").alias("b"))).distinct()
        small_low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            salted_join(large, small_low, "a", F.col("b"), few=few)
            .select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e"))
            .select("e.a", "e.b")
            .where("a <> b")
            .distinct()
        )
        near = cut(small, "edges")
        state = near.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()
        if state == previous:
            break
        previous, n = state, state[0]
    return near.groupBy("a").agg(F.min("b").alias("component")).select(F.col("a").alias("id"), "component").unionByName(
        near.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct().join(near.select(F.col("a").alias("id")), "id", "left_anti")
    )
