"""Session helpers: a local session for tests and benches, and the shared folder for written tables."""

from __future__ import annotations

import functools
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()

#: Rows that a Python function works on at once, and bytes that Spark hands to a worker at once: long texts must not add up.
BATCH_ROWS, BATCH_BYTES = 256, "4m"
#: Rows that one task keeps in memory to join, number or make distinct, before more tasks are asked for.
TASK_ROWS = 500_000


def local_session(cores: str | int = "*", shuffle_partitions: int = 8, app: str = "peerlens") -> SparkSession:
    """Session for tests and benches; a cluster job brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        # Sort-merge joins turn into hash joins where every build partition has been measured to be small.
        .config("spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold", "64MB")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("PEERLENS_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_root(spark: SparkSession) -> str:
    """Folder every executor can reach: ``spark.checkpoint.dir``, with a temporary one for local masters only."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        root = _local_root()
    return root.rstrip("/")


@functools.cache
def _local_root() -> str:
    return tempfile.mkdtemp(prefix="peerlens-")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/peerlens/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def pin(df: DataFrame, name: str = "pin") -> DataFrame:
    """Write the frame to the shared folder and read it back.

    Cuts lineage, survives lost executors, and fixes columns whose value depends on the
    physical layout (row positions) before they are used twice.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Deal the rows of an input with fewer splits than cores over all cores, ahead of CPU-heavy row work.

    Inputs with enough splits pass unchanged, so only small data is ever moved.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """The frame dealt by keys over as many tasks as so many rows need; unchanged where the session's number of tasks is enough.

    A fixed number of tasks would let what one of them holds grow with the input.
    """
    tasks = -(-rows // TASK_ROWS)
    return df.repartition(tasks, *keys) if tasks > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def short_batches(df: DataFrame) -> DataFrame:
    """The same frame; what its session hands to Python workers is cut by bytes, not only by rows."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return df


def slices(parts: Iterator, rows: int = BATCH_ROWS) -> Iterator:
    """Arrow batches or pandas frames, cut to a few hundred rows each."""
    for part in parts:
        for at in range(0, len(part), rows):
            yield part[at : at + rows] if hasattr(part, "iloc") else part.slice(at, rows)


@functools.cache
def _package_zip() -> str:
    package = os.path.dirname(os.path.abspath(__file__))
    base = os.path.join(tempfile.mkdtemp(prefix="peerlens-zip-"), "peerlens")
    return shutil.make_archive(base, "zip", os.path.dirname(package), os.path.basename(package))


def ship(spark: SparkSession) -> None:
    """Give the Python workers this package, once per application."""
    sc = spark.sparkContext
    if sc.applicationId not in _SHIPPED:
        sc.addPyFile(_package_zip())
        _SHIPPED.add(sc.applicationId)
