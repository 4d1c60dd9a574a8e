"""Leakage-free folds, hold-outs and samples on the portable hash: the same rows everywhere, every time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peerlens.functions.hashing import portable_hash, unit_hash
from peerlens.operators.grouped import hash_rank


def group_kfold(df: DataFrame, group: str, k: int = 4, seed=42, *, balanced: bool = True, name: str = "fold") -> DataFrame:
    """Fold of each row; a group is never split. Balanced folds deal the hash-ordered groups out in turn."""
    if not balanced:
        return df.withColumn(name, (portable_hash(seed, group) % k).cast("long"))
    groups = df.select(group).distinct().withColumn("_h", portable_hash(seed, group)).withColumn("_one", F.lit(0))
    ranked = hash_rank(groups, "_one", group, "_h")
    return df.join(ranked.select(group, (F.col("rank") % k).alias(name)), group)


def group_shuffle(df: DataFrame, group: str, test: float = 0.3, seed=85, name: str = "is_test") -> DataFrame:
    """1 for about ``test`` of the groups."""
    return df.withColumn(name, (unit_hash(seed, group) < test).cast("int"))


def _classes(df: DataFrame, label: str) -> DataFrame:
    """Adds the class as text; rows without a label are a class of their own."""
    text = F.col(label).cast("string")
    return df.withColumn("_class", F.when(text.isNull(), "-").otherwise(F.concat(F.lit("+"), text)))


def stratified_split(df: DataFrame, label: str, key: str, share: float = 0.1, seed=1, name: str = "is_valid") -> DataFrame:
    """1 for exactly floor(share * n) rows of each class."""
    ranked = hash_rank(_classes(df, label).withColumn("_h", portable_hash(seed, key)), "_class", key, "_h", rank="_r")
    return ranked.withColumn(name, (F.col("_r") < F.floor(F.col("_n") * share)).cast("int")).drop("_r", "_n", "_h", "_class")


def stratified_kfold(df: DataFrame, label: str, key: str, k: int = 5, seed=92, name: str = "fold") -> DataFrame:
    """Folds of equal size within each class."""
    ranked = hash_rank(_classes(df, label).withColumn("_h", portable_hash(seed, key)), "_class", key, "_h", rank="_r")
    return ranked.withColumn(name, F.col("_r") % k).drop("_r", "_n", "_h", "_class")


def negative_downsample(df: DataFrame, query: str, key: str, target: str, keep: float = 0.05, seed=42) -> DataFrame:
    """All positives and about ``keep`` of the negatives; queries without a positive are dropped."""
    useful = df.where(F.col(target) == 1).select(query).distinct()
    chosen = (F.col(target) == 1) | (unit_hash(seed, query, key) < keep)
    return df.where(chosen).join(useful, query, "left_semi")
