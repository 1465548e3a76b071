"""What several operators share: written intermediates and connected components."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import shutil
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.workers import ship


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir), or one of our own where it is unset and all run on this machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="glyphmill-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def give_back() -> None:
    """Return freed memory to the operating system: the driver lives on after a fit, and so do workers after a task."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def frugal(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, after which a worker keeps no more than it needs; idle workers stay beside busy ones."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return task


_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def lean(df: DataFrame) -> DataFrame:
    """df, in a session whose Arrow batches hold 8 MB, unless the session has a size of its own: texts are long, and each
    batch is held several times over on its way to a worker and back."""
    ship(df.sparkSession)
    conf = df.sparkSession.conf
    if conf.get(_BATCH) == "67108864b":
        conf.set(_BATCH, "8m")
    return df


class _Tables(threading.local):
    """What `written` has left; each thread knows its own, so that pipelines side by side leave each other's tables alone."""

    def __init__(self) -> None:
        self.paths: list[str] = []


_tables = _Tables()


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it again: lineage ends there and no executor's loss costs a recomputation."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _tables.paths.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tables_written() -> int:
    return len(_tables.paths)


def forget(spark: SparkSession, since: int = 0, keep_last: int = 0) -> None:
    """Delete what `written` has left in this thread, from the `since`-th table on, but for the last keep_last.

    For callers who have written or read out a result: frames that still read those tables fail afterwards.
    """
    gone = _tables.paths[since : len(_tables.paths) - keep_last]
    for path in gone:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    del _tables.paths[since : len(_tables.paths) - keep_last]


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of edges (a, b): root is the smallest node that can be reached.

    Large-star and small-star rounds in turn, each a map-side combined minimum and a join, until the edges
    stand still. No neighbour list is gathered; every round is written to the shared folder. Loops and nulls
    are left out, so a node whose only edge is a loop does not appear.
    """
    now = written(edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = None
    for _ in range(max_rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # Minima are written before they are joined: a join of two plain exchanges can split the rows of a large hub.
        least = written(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m")), "least")
        large = written(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct(), "large")
        least = written(large.groupBy("a").agg(F.min("b").alias("m")), "least")
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        now = written(small.select("e.*").where("a <> b").distinct(), "edges")
        last, mark = mark, tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if last == mark:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return written(roots.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()), "components")
