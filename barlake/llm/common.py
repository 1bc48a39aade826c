"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space; a word is a run of anything else.
SPACE = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    The session's ``spark.checkpoint.dir``; only where that is unset (tests, a
    single machine) a new temporary folder becomes the checkpoint folder.
    """
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = "file://" + tempfile.mkdtemp(prefix="barlake-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(where)
    return where


def scratch_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, what: str) -> DataFrame:
    """Cut the lineage: write the rows as Parquet to the shared folder, read them."""
    spark = df.sparkSession
    path = scratch_path(spark, what)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def forget(*frames: DataFrame) -> None:
    """Delete what ``materialize`` wrote for these, once all that reads it has been written itself."""
    for df in frames:
        path = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(df.scratch)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def spread_join(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """``rows`` joined to the ``groups`` of their key, of which ``size`` of all ``total`` rows are members.

    Groups of more than a share of the rows, of which there can be but a few for
    each partition, are broadcast, so their rows stay where they are; the others
    are joined by a shuffle.
    """
    share = total // (8 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))) + 1
    hot = groups.where(F.col(size) > share)
    frequent = rows.join(F.broadcast(hot), key)
    rare = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(groups.where(F.col(size) <= share), key)
    return frequent.unionByName(rare)


_remembered: list[Callable] = []


def remembered(make: Callable) -> Callable:
    """What ``make`` gives stays in a worker for later tasks, until one that doesn't use it ends."""
    kept = lru_cache(1)(make)
    _remembered.append(kept)
    return kept


def release(keep: Callable | None = None) -> None:
    """Drop what tasks of other operators have left in this worker; freed memory goes back to the system."""
    for kept in _remembered:
        if kept is not keep:
            kept.cache_clear()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where the C library has no such call
        ctypes.CDLL(None).malloc_trim(0)


def trimmed(run: Callable[[Iterator], Iterator], keep: Callable | None = None) -> Callable[[Iterator], Iterator]:
    """``run``, and at its end ``release``: workers wait for their next task beside the executor's heap."""

    def whole(batches: Iterator) -> Iterator:
        yield from run(batches)
        release(keep)

    return whole


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """What is written in here travels to Python in batches of so many rows at most: of whole texts Spark's 10,000 are some 25 MB, held more than once on either side."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    if not 0 < int(before) <= rows:
        spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def training_rows(column: str, modulus: int) -> F.Column:
    """The remainder of crc32 of an id as text."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, component)`` for every node of an undirected edge table.

    The component is the smallest node that edges reach.  Alternating large-star
    and small-star contraction: every round keeps at most the number of edges, a
    hub's rows are aggregated before the shuffle and joined by plain joins that
    adaptive execution may split, and the rounds grow with the logarithm of the
    longest path.  No component is collected anywhere.
    """
    state = materialize(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "edges"
    )
    nodes = materialize(state.select(F.col("u").alias("node")).union(state.select("v")).distinct(), "nodes")
    seen = None
    while True:
        both = state.union(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(down).where("u <> v")
        last, state = state, materialize(small.distinct(), "edges")
        forget(last)
        now = state.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    label = state.groupBy("u").agg(F.min("v").alias("component"))
    named = nodes.join(label, nodes["node"] == label["u"], "left").select(
        "node", F.coalesce("component", "node").alias("component")
    )
    named = materialize(named, "components")
    forget(state, nodes)
    return named
