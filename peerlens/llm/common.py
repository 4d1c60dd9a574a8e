"""Helpers shared by the operators: tables, Python batches of bounded size, written tables, hash shares."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peerlens.runtime import pin, ship

#: What a function sees at once, and what Spark hands to a Python worker at once: long texts must not add up.
BATCH_ROWS, BATCH_BYTES = 256, "4m"

#: The words of ASCII-spaced text; the same class in Java, Python and RE2.
SPACES = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def batches(df: DataFrame, function: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """Apply a function to every Arrow batch of a few hundred rows; None is left out."""
    return streams(df, lambda parts: (out for part in parts if (out := function(part)) is not None), schema)


def streams(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """Apply a function to the stream of Arrow batches of each partition, cut to a few hundred rows each."""
    spark = df.sparkSession
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from function(part.slice(at, BATCH_ROWS) for part in parts for at in range(0, part.num_rows, BATCH_ROWS))

    return df.mapInArrow(run, schema)


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text, null as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def crc_share(column: str, parts: int) -> F.Column:
    """crc32 of the id written as text, modulo ``parts``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % parts


def aside(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: later reads cost no second run and survive lost executors."""
    return pin(df, name)
