"""Readers with declared schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUESTIONS = "question string, body string, pids array<string>"
PAPER_VALUE = "struct<title:string,abstract:string>"


def read_jsonl(spark: SparkSession, path: str, schema: str = QUESTIONS) -> DataFrame:
    """One JSON object per line; a field that a line lacks is NULL."""
    return spark.read.schema(schema).json(path)


def read_json_map(
    spark: SparkSession, path: str, value: str = PAPER_VALUE, key: str = "pid", *, one_object_per_file: bool = False
) -> DataFrame:
    """JSON objects keyed by id, one row per entry.

    Objects one per line are split over tasks. ``one_object_per_file`` reads a file that is a single
    pretty-printed object; such a file cannot be split, so convert it to Parquet once.
    """
    lines = spark.read.text(path, wholetext=one_object_per_file)
    entries = lines.select(F.explode(F.from_json("value", f"map<string,{value}>")).alias(key, "_v"))
    return entries.select(key, "_v.*")


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header whose quoted fields may hold quotes and line breaks."""
    return spark.read.options(header=True, multiLine=True, quote='"', escape='"').schema(schema).csv(path)


def read_parquet(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def papers_schema() -> T.StructType:
    """Raw paper records: the value type of the id-keyed paper file."""
    author = T.StructType([T.StructField("name", T.StringType()), T.StructField("org", T.StringType())])
    return T.StructType(
        [
            T.StructField("id", T.StringType()),
            T.StructField("title", T.StringType()),
            T.StructField("abstract", T.StringType()),
            T.StructField("keywords", T.ArrayType(T.StringType())),
            T.StructField("authors", T.ArrayType(author)),
            T.StructField("venue", T.StringType()),
            T.StructField("year", T.StringType()),
        ]
    )
