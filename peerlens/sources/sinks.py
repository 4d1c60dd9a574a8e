"""Writers for feature tables, predictions and ranked exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peerlens.operators.grouped import dense_index
from peerlens.operators.neighbours import top_per_key

MAX_ITEMS = 100_000


def write_parquet(df: DataFrame, path: str, *partition_by: str) -> None:
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").options(header=True, quote='"', escape='"').csv(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    """One JSON object per line; NULL fields are left out."""
    df.write.mode("overwrite").option("ignoreNullFields", "true").json(path)


def ranked_lines(df: DataFrame, query: str, item: str, order: list[Column], k: int = 20) -> DataFrame:
    """One comma-joined line of the k best items per query."""
    best = top_per_key(df, query, order, k)
    listed = best.groupBy(query).agg(F.sort_array(F.collect_list(F.struct("rank", F.col(item).cast("string").alias("i")))).alias("_l"))
    return listed.select(query, F.array_join(F.transform("_l", lambda x: x["i"]), ",").alias("line"))


def write_ranked_text(df: DataFrame, path: str, query: str, item: str, order: list[Column], k: int = 20) -> None:
    """Text file without header, one line per query in query order."""
    ranked_lines(df, query, item, order, k).orderBy(query).select("line").write.mode("overwrite").text(path)


def implode_map(df: DataFrame, group: str, item: str, value: str, *, max_items: int = MAX_ITEMS) -> DataFrame:
    """Rows to maps {item: value}: (group, part, map). A group beyond ``max_items`` gives several parts, in item order over all parts.

    Of a repeated (group, item) the largest value stays.
    """
    placed = dense_index(df.groupBy(group, item).agg(F.max(value).alias(value)), group, item).withColumn("part", F.floor(F.col("idx") / max_items).cast("long"))
    entries = F.sort_array(F.collect_list(F.struct(item, value)))
    return placed.groupBy(group, "part").agg(F.map_from_entries(entries).alias("map"))


def group_json(df: DataFrame, group: str, item: str, value: str, *, max_items: int = MAX_ITEMS) -> DataFrame:
    """Lines ``{"group":{"item":value,..}}``; a group beyond ``max_items`` is spread over several lines."""
    text = df.select(F.col(group).cast("string").alias("g"), F.col(item).cast("string").alias("i"), F.col(value).alias("v"))
    parts = implode_map(text, "g", "i", "v", max_items=max_items)
    return parts.select(F.to_json(F.create_map("g", "map")).alias("line"))


def write_group_json(df: DataFrame, path: str, group: str, item: str, value: str, **how) -> None:
    group_json(df, group, item, value, **how).write.mode("overwrite").text(path)
