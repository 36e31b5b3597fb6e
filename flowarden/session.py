"""Session settings and the shared working folder."""

from __future__ import annotations

import tempfile
import uuid

from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from contextvars import ContextVar, copy_context
from typing import TypeVar

from pyspark.sql import DataFrame, SparkSession

T = TypeVar("T")
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
CONCURRENT = 4  # jobs a driver keeps going at the same time

_owner: ContextVar[str] = ContextVar("owner", default="")


def local_session(cores: str | int = "*", partitions: int = 8, name: str = "flowarden") -> SparkSession:
    """A single-machine session for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.scheduler.mode", "FAIR")
        .config("spark.driver.memory", "12g")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.driver.bindAddress", "127.0.0.1")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, taken from ``spark.checkpoint.dir``.

    Only a local-mode session without that setting gets a temporary folder of its own.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        root = tempfile.mkdtemp(prefix="flowarden-")
        spark.conf.set("spark.checkpoint.dir", root)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder, or below the folder of the block that owns intermediates."""
    return f"{_owner.get() or shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


@contextmanager
def owned_intermediates(spark: SparkSession) -> Iterator[str]:
    """Own what a block stores: everything ``materialise`` writes in it is deleted when it ends.

    Results must be read or written before the end. Without an owner intermediates stay in the shared folder.
    """
    path = scratch_path(spark, "owned")
    token = _owner.set(path)
    try:
        yield path
    finally:
        _owner.reset(token)
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def materialise(df: DataFrame, label: str, codec: str | None = None) -> DataFrame:
    """Write ``df`` once below the shared folder and read it back.

    For results that several later jobs start from: they then read a small column table instead of
    repeating the work, and a lost executor loses nothing. ``codec`` takes the place of the session's.
    """
    path = scratch_path(df.sparkSession, label)
    (df.write.option("compression", codec) if codec else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is written in the block go with the end of each write, not when the driver collects its garbage."""
    before = spark.conf.get(FREE_SHUFFLES, "false")
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.set(FREE_SHUFFLES, before)


def concurrently(spark: SparkSession, steps: Sequence[Callable[[], T]], most: int = CONCURRENT) -> list[T]:
    """The results of independent steps, in order, with up to ``most`` of them submitting jobs at the same time.

    Model fits are chains of small jobs that leave most of a cluster idle. Every step runs in a driver thread with its
    own scheduler pool, so under fair scheduling a long one does not hold up the others; intermediates keep their owner.
    """

    def run(at: int, step: Callable[[], T]) -> T:
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"step-{at % most}")
        try:
            return step()
        finally:
            spark.sparkContext.setLocalProperty("spark.scheduler.pool", None)

    with ThreadPoolExecutor(max(1, min(most, len(steps)))) as pool:
        started = [pool.submit(copy_context().run, run, at, step) for at, step in enumerate(steps)]
        return [s.result() for s in started]


SMALL_SPLIT = 8 * 1024 * 1024  # bytes a core from which a file's own splits are left to read it


def spread(df: DataFrame) -> DataFrame:
    """Deal a small under-split table over all cores before CPU-heavy work.

    A single small file is read by one task. Only a table of fewer files than cores and less than a small split (8 MB)
    per core is shuffled: Spark cuts anything larger into a split per core at least, and a shuffle into as many tasks as
    cores would give each task a share that grows with the table.
    """
    if df.isStreaming:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    files = len(df.inputFiles())
    if not 0 < files < cores:
        return df
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size <= cores * SMALL_SPLIT else df
