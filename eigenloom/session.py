"""Sessions, shared storage, lineage cuts and size-checked joins."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side with at most this many rows may be broadcast by ``join_checked``.
BROADCAST_ROWS = 1_000_000
#: Bytes of input that one partition of a planned range exchange should hold.
TARGET_PARTITION_BYTES = 128 << 20


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session for tests and the bench; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("eigenloom")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("EIGENLOOM_DRIVER_MEMORY", "12g"))
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is what the session names in ``spark.checkpoint.dir``; only where that
    is unset on a local master (tests, a notebook on one machine) a temporary
    folder is made and named there. A cluster without it is refused: its
    executors would each write to a folder of their own machine.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="eigenloom-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_table_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/eigenloom/{name}-{uuid.uuid4().hex}"


def _hadoop_path(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def path_exists(spark: SparkSession, path: str) -> bool:
    at, fs = _hadoop_path(spark, path)
    return fs.exists(at)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a table that was written with ``materialise``."""
    at, fs = _hadoop_path(spark, path)
    fs.delete(at, True)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` to the shared folder and read it back.

    The files outlive executors, are columnar, and give later plans real sizes
    to choose joins by. They are deleted when the JVM ends.
    """
    spark = df.sparkSession
    path = new_table_path(spark, name)
    df.write.parquet(path)
    at, fs = _hadoop_path(spark, path)
    fs.deleteOnExit(at)
    out = spark.read.schema(df.schema).parquet(path)
    out._eigenloom_path = path
    return out


def release(df: DataFrame) -> None:
    """Delete the files of a table from ``materialise`` that nothing reads any more."""
    if path := getattr(df, "_eigenloom_path", None):
        drop_path(df.sparkSession, path)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Within it, what a finished query has shuffled is deleted at once, not when the driver next collects garbage.

    For operators that write several tables one after another.
    """
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def at_most(df: DataFrame, rows: int) -> bool:
    """Whether ``df`` has no more than ``rows`` rows (a distributed count)."""
    return df.count() <= rows


def join_checked(left: DataFrame, right: DataFrame, on, how: str = "inner", rows: int = BROADCAST_ROWS) -> DataFrame:
    """Join; ``right`` is broadcast only if it has been counted as small.

    Beyond ``rows`` rows it is an ordinary equi-join, whose skewed partitions
    adaptive execution splits.
    """
    return left.join(F.broadcast(right) if at_most(right, rows) else right, on, how)


def estimated_bytes(df: DataFrame) -> int:
    """The optimiser's estimate of ``df``'s size."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def planned_partitions(df: DataFrame, target_bytes: int = TARGET_PARTITION_BYTES) -> int:
    """Partitions for an explicit exchange of ``df``: the session's number, or more if they would be too large."""
    floor = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(floor, min(1_000_000, -(-estimated_bytes(df) // target_bytes)))


def free_name(df: DataFrame, base: str) -> str:
    """``base``, with underscores before it until no column of ``df`` is called so (case ignored)."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base = "_" + base
    return base


def null_safe(left: DataFrame, right: DataFrame, pairs: list[tuple[str, str]]) -> Column:
    """A null-safe equality of the named column pairs, usable as a hash-join condition."""
    condition = None
    for a, b in pairs:
        equal = left[a].eqNullSafe(right[b])
        condition = equal if condition is None else condition & equal
    return condition


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give this package to the executors, once an application.

    Needed only where it is not installed there and not on their path.
    """
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    archive = os.path.join(tempfile.mkdtemp(prefix="eigenloom-"), "eigenloom.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _, names in os.walk(os.path.join(root, "eigenloom")):
            for name in names:
                if name.endswith(".py"):
                    at = os.path.join(folder, name)
                    out.write(at, os.path.relpath(at, root))
    spark.sparkContext.addPyFile(archive)
    _SHIPPED.add(app)


#: Rows of whole texts that go to a Python worker at once, where the session has Spark's default.
TEXT_ROWS = 1000


def text_batches(spark: SparkSession) -> None:
    """Let Arrow batches hold fewer rows than Spark's default: rows of texts are wide, and a worker holds a batch or two."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(TEXT_ROWS))


@contextmanager
def single_rows(spark: SparkSession) -> Iterator[None]:
    """Within it, Arrow batches of an action hold one row: for rows that are whole blocks, of which a worker should hold one."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "1")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def delete_at_exit(spark: SparkSession, path: str) -> None:
    """Have a table that exists deleted when the JVM ends."""
    at, fs = _hadoop_path(spark, path)
    fs.deleteOnExit(at)


def few_values(df: DataFrame, column: str, most: int = 10_000) -> list:
    """Distinct values of a column that a panel's names are in; more than ``most`` are an error, never brought whole."""
    found = [r[0] for r in df.select(column).distinct().limit(most + 1).collect()]
    if len(found) > most:
        raise ValueError(f"{column} has more than {most} values")
    return found
