"""Session settings and shared scratch space."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

# Runtime settings only: a cluster's memory and cores stay as its operator chose them.
_RUNTIME = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # A shuffle is dealt finely and put together again by bytes, so that what one task
    # sorts or hashes does not grow with the tables, however few partitions are set.
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "1000",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m",
    # The same for what a task reads of a file and aggregates before the shuffle.
    "spark.sql.files.maxPartitionBytes": "32m",
    # Equi joins on a hot key are split at run time, also where the split costs
    # one more exchange above the join.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    # Statement folders have very many small files: by default Spark lists each folder in
    # a task of its own and reads a few dozen files per task.
    "spark.sql.sources.parallelPartitionDiscovery.parallelism": "64",
    "spark.sql.files.openCostInBytes": "262144",
    # Shuffled rows go when the query that shuffled them has ended: what is read again is stored.
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.parquet.compression.codec": "zstd",
    # Listed files are held by the frame that reads them, not by the session as well.
    "spark.sql.hive.filesourcePartitionFileCacheSize": "0",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings the operators are designed for."""
    for key, value in _RUNTIME.items():
        spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local session that names none gets a temporary folder: on a cluster
    each machine would write to its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    master = spark.sparkContext.master
    if not named and master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not named:
        named = tempfile.mkdtemp(prefix="run-tallybook-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/tallybook-{label}-{uuid.uuid4().hex}"


# What was stored within the innermost ``passing`` block, by path.
_passing: ContextVar[dict[str, DataFrame] | None] = ContextVar("passing", default=None)


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, and
    survives the loss of any executor. ``released`` and ``passing`` remove the files again."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return _noted(df.sparkSession.read.schema(df.schema).parquet(path), path)


def _noted(frame: DataFrame, path: str) -> DataFrame:
    frame.stored_at = path
    within = _passing.get()
    if within is not None:
        within[path] = frame
    return frame


def stored_parts(parts: Iterable[DataFrame], label: str) -> DataFrame:
    """Frames of the same columns as one, each written before the next is asked for, so that what one
    of them holds of the driver's memory (a listing of files, say) can go. At least one."""
    path = ""
    for part in parts:
        spark, schema = part.sparkSession, part.schema
        path = path or scratch_path(spark, label)
        part.write.mode("append").parquet(path)
    return _noted(spark.read.schema(schema).parquet(path), path)


@contextmanager
def passing() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """A block whose stored frames are removed at its end, but for those given to the
    function it yields: these outlast it and are left to the block around, if any. Whatever
    else outlasts it must not read what was stored in it."""
    within: dict[str, DataFrame] = {}
    outer = _passing.get()
    token = _passing.set(within)

    def keep(frame: DataFrame) -> DataFrame:
        if within.pop(frame.stored_at, None) is not None and outer is not None:
            outer[frame.stored_at] = frame
        return frame

    try:
        yield keep
    finally:
        _passing.reset(token)
    released(*within.values())


def removed(spark: SparkSession, path: str) -> None:
    """Remove a file or folder in whatever store its path names."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def released(*frames: DataFrame) -> None:
    """Remove the files of stored frames that nothing reads any more: what was derived
    from them has itself been stored."""
    for frame in frames:
        removed(frame.sparkSession, frame.stored_at)
