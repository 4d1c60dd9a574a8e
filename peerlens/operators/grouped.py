"""Group-relative building blocks that stay balanced when one group holds a large share of all rows.

A plain window over a group puts the whole group in one task. Here a group is summarised by a
map-side combined aggregate and the one-row summary is joined back with a salt; ordered work uses
one range-partitioned sort over (group, order) so that a hot group spans many partitions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from peerlens.runtime import pin

SPLIT_ROWS = 1_000_000


def as_list(keys) -> list[str]:
    return [keys] if isinstance(keys, str) else list(keys)


def attach(
    rows: DataFrame,
    stats: DataFrame,
    keys: str | Sequence[str],
    spread_by: str | Sequence[str],
    *,
    size: str = "_n",
    how: str = "inner",
    split_rows: int = SPLIT_ROWS,
) -> DataFrame:
    """Join one-row-per-key ``stats`` (with its row count in ``size``) to ``rows``.

    A key with more than ``split_rows`` rows is split by a hash of ``spread_by`` into
    ceil(size/split_rows) parts and its stats row is copied once per part. The list of such keys is
    at most total_rows/split_rows long, which is what makes its broadcast safe.
    """
    keys = as_list(keys)
    salted = salt_rows(rows, stats, keys, spread_by, size=size, split_rows=split_rows)
    return salted.join(salt_copies(stats, size=size, split_rows=split_rows), keys + ["_salt"], how).drop("_salt")


def salt_rows(
    rows: DataFrame, stats: DataFrame, keys, spread_by, *, size: str = "_n", split_rows: int = SPLIT_ROWS
) -> DataFrame:
    """The row side of ``attach``: adds ``_salt``. Loops salt their rows once and join new stats every round."""
    keys = as_list(keys)
    parts = F.ceil(F.col(size) / F.lit(split_rows)).cast("int")
    hot = stats.where(F.col(size) > split_rows).select(*keys, parts.alias("_parts"))
    salt = F.pmod(F.xxhash64(*as_list(spread_by)), F.coalesce("_parts", F.lit(1))).cast("int")
    return rows.join(F.broadcast(hot), keys, "left").withColumn("_salt", salt).drop("_parts")


def salt_copies(stats: DataFrame, *, size: str = "_n", split_rows: int = SPLIT_ROWS) -> DataFrame:
    """The stats side of ``attach``: one copy of a key's row per part of the key."""
    parts = F.ceil(F.col(size) / F.lit(split_rows)).cast("int")
    return stats.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.greatest(parts, F.lit(1)) - 1)))


def _has_hot(rows: DataFrame, keys: list[str], split_rows: int) -> bool:
    """Does any key hold more than ``split_rows`` rows? Decides between a window and a split plan."""
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    largest = sizes.agg(F.max("_n")).first()[0]
    return largest is not None and largest > split_rows


def with_group_stats(
    rows: DataFrame, keys, spread_by, aggs: Sequence[Column], *, split_rows: int = SPLIT_ROWS
) -> DataFrame:
    """``rows`` plus group aggregates; the skew-safe form of ``agg().over(partitionBy(keys))``."""
    stats = rows.groupBy(*as_list(keys)).agg(F.count(F.lit(1)).alias("_n"), *aggs)
    return attach(rows, stats, keys, spread_by, split_rows=split_rows)


def dense_index(
    rows: DataFrame, keys, item: str, *, index: str = "idx", size: str = "deg", split_rows: int = SPLIT_ROWS
) -> DataFrame:
    """Number the rows of each key 0..n-1 (``index``) and add n (``size``).

    Every key is numbered in ``item`` order, whatever its size (see ``group_ranks``).
    """
    ranked = group_ranks(rows, keys, [F.col(item)], item, rank=index, split_rows=split_rows)
    return ranked.withColumn(index, F.col(index) - 1).withColumnRenamed("_n", size)


def hash_rank(
    rows: DataFrame, keys, item: str, hashed: str, *, rank: str = "rank", split_rows: int = SPLIT_ROWS
) -> DataFrame:
    """Rank (from 0) of every row in its key by (``hashed``, ``item``); ``hashed`` is uniform in 0..2**32-1.

    The high part of a uniform hash is a balanced, order-preserving bucket, so a key of any size is
    ranked inside buckets of about ``split_rows`` rows plus the exact sizes of the buckets before.
    Adds the key size as ``_n``.
    """
    keys = as_list(keys)
    counted = with_group_stats(rows, keys, item, [], split_rows=split_rows)
    buckets = F.ceil(F.col("_n") / F.lit(split_rows))
    bucketed = counted.withColumn("_b", F.floor(F.col(hashed) * buckets / F.lit(float(1 << 32))).cast("long"))
    sizes = bucketed.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_c"))
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select(*keys, "_b", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_shift"))
    local = Window.partitionBy(*keys, "_b").orderBy(hashed, item)
    return (
        bucketed.withColumn("_rn", F.row_number().over(local) - 1)
        .join(shifts, keys + ["_b"])
        .withColumn(rank, (F.col("_rn") + F.col("_shift")).cast("long"))
        .drop("_rn", "_shift", "_b")
    )


def running_totals(rows: DataFrame, order: Sequence[Column], values: dict[str, str]) -> DataFrame:
    """Exclusive running totals of columns over one total order of all rows, without a one-task window.

    ``values`` maps new column -> summed column. The rows are range-sorted (ties and hot keys spread
    over partitions), pinned, summed inside each physical partition, and shifted by the partition
    totals, of which there are as many as partitions.
    """
    placed = pin(rows.orderBy(*order).withColumn("_pos", F.monotonically_increasing_id()), "sorted")
    placed = placed.withColumn("_part", F.shiftright("_pos", 33))
    names = list(values)
    totals = placed.groupBy("_part").agg(*[F.sum(values[v]).alias(f"_t_{v}") for v in names])
    earlier = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = totals.select(
        "_part", *[F.coalesce(F.sum(f"_t_{v}").over(earlier), F.lit(0)).alias(f"_s_{v}") for v in names]
    )
    local = Window.partitionBy("_part").orderBy("_pos").rowsBetween(Window.unboundedPreceding, -1)
    out = placed
    for v in names:
        out = out.withColumn(f"_l_{v}", F.coalesce(F.sum(values[v]).over(local), F.lit(0)))
    out = out.join(F.broadcast(shifts), "_part")
    for v in names:
        out = out.withColumn(v, F.col(f"_l_{v}") + F.col(f"_s_{v}"))
    return out.drop("_pos", "_part", *[f"_l_{v}" for v in names], *[f"_s_{v}" for v in names])


def row_positions(rows: DataFrame, order: Sequence[Column], name: str = "pos") -> DataFrame:
    """Dense position 0..n-1 of each row in a total order; a distributed ``row_number() - 1``."""
    placed = pin(rows.orderBy(*order).withColumn("_pos", F.monotonically_increasing_id()), "sorted")
    placed = placed.withColumn("_part", F.shiftright("_pos", 33))
    totals = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_c"))
    earlier = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = totals.select("_part", F.coalesce(F.sum("_c").over(earlier), F.lit(0)).alias("_shift"))
    local = F.col("_pos").bitwiseAND(F.lit((1 << 33) - 1))
    return (
        placed.join(F.broadcast(shifts), "_part")
        .withColumn(name, (local + F.col("_shift")).cast("long"))
        .drop("_pos", "_part", "_shift")
    )


def group_ranks(
    rows: DataFrame, keys, order: Sequence[Column], spread_by, *, rank: str = "rank", split_rows: int = SPLIT_ROWS
) -> DataFrame:
    """Rank (from 1) inside each key by a total ``order``; adds the key size as ``_n``.

    While every key has at most ``split_rows`` rows this is a window; one larger key sends all rows
    through the range-partitioned sort.
    """
    keys = as_list(keys)
    if not _has_hot(rows, keys, split_rows):
        w = Window.partitionBy(*keys)
        return rows.withColumn(rank, F.row_number().over(w.orderBy(*order)).cast("long")).withColumn(
            "_n", F.count(F.lit(1)).over(w)
        )
    placed = row_positions(rows, [F.col(k) for k in keys] + list(order), "_at")
    first = [F.min("_at").alias("_from")]
    return (
        with_group_stats(placed, keys, spread_by, first, split_rows=split_rows)
        .withColumn(rank, F.col("_at") - F.col("_from") + 1)
        .drop("_at", "_from")
    )


def group_quantiles(
    rows: DataFrame, keys, value: str, spread_by, quantiles: dict[str, float], *, split_rows: int = SPLIT_ROWS
) -> DataFrame:
    """Exact linear-interpolated quantiles per key, with the number of values as ``_n``.

    Keys up to ``split_rows`` values use the built-in percentile. Larger keys are sorted across
    partitions, and only the two ranks next to each quantile are kept.
    """
    keys = as_list(keys)
    names = keys + [s for s in as_list(spread_by) if s not in keys]
    kept = rows.where(F.col(value).isNotNull()).select(*names, value)
    sizes = kept.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    hot = sizes.where(F.col("_n") > split_rows)
    exact = [F.percentile(value, F.lit(q)).alias(name) for name, q in quantiles.items()]
    if not hot.select(F.lit(1)).limit(1).count():
        return kept.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *exact)
    big = F.broadcast(hot.select(*keys))
    small = kept.join(big, keys, "left_anti").groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *exact)
    order = [F.col(value), *map(F.col, as_list(spread_by))]
    ranked = group_ranks(kept.join(big, keys, "left_semi"), keys, order, spread_by, rank="_r", split_rows=split_rows)
    aggs = []
    for name, q in quantiles.items():
        at = F.lit(q) * (F.col("_n") - 1)
        low = F.floor(at)
        lo = F.max(F.when(F.col("_r") == low + 1, F.col(value)))
        hi = F.max(F.when(F.col("_r") == F.ceil(at) + 1, F.col(value)))
        share = F.max(at - low)
        aggs.append((lo + (hi - lo) * share).alias(name))
    return small.unionByName(ranked.groupBy(*keys).agg(F.max("_n").alias("_n"), *aggs))


def grouped_map(
    df: DataFrame,
    keys: Sequence[str],
    fn: Callable[[tuple, pd.DataFrame], Sequence],
    schema: T.StructType,
    order: Sequence[str] = (),
) -> DataFrame:
    """Apply ``fn(key, rows) -> list of output columns`` to every key.

    Same contract as ``applyInPandas`` but a partition is read in Arrow batches, so thousands of
    small groups share one batch; only one group at a time is carried across batches.
    """
    keys = list(keys)
    names = schema.fieldNames()

    def flush(pdf: pd.DataFrame, out: list[list]) -> None:
        cuts = np.zeros(len(pdf), dtype=bool)
        for k in keys:
            col = pdf[k].to_numpy()
            cuts[1:] |= col[1:] != col[:-1]
        starts = np.flatnonzero(cuts)
        bounds = np.concatenate([[0], starts, [len(pdf)]])
        for lo, hi in zip(bounds[:-1], bounds[1:]):
            part = pdf.iloc[lo:hi]
            result = fn(tuple(part[k].iat[0] for k in keys), part)
            if result is not None:
                for acc, col in zip(out, result):
                    acc.extend(col)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for pdf in batches:
            if not len(pdf):
                continue
            held = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            same = np.ones(len(held), dtype=bool)
            for k in keys:
                col = held[k].to_numpy()
                same &= col == col[-1]
            tail = np.flatnonzero(~same)
            done = tail[-1] + 1 if len(tail) else 0
            if done:
                out: list[list] = [[] for _ in names]
                flush(held.iloc[:done], out)
                held = held.iloc[done:].reset_index(drop=True)
                yield pd.DataFrame({n: pd.Series(c, dtype=object) for n, c in zip(names, out)})
        if held is not None and len(held):
            out = [[] for _ in names]
            flush(held, out)
            yield pd.DataFrame({n: pd.Series(c, dtype=object) for n, c in zip(names, out)})

    # An explicit count: the work per byte is high, so small partitions must not be merged.
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ready = df.repartition(tasks, *keys).sortWithinPartitions(*keys, *order)
    return ready.mapInPandas(run, schema)


def zscore(df: DataFrame, group, key, cols: dict[str, str]) -> DataFrame:
    """z-scores inside a group with the population deviation; NULL where it is zero."""
    stats = [x for n, c in cols.items() for x in (F.avg(c).alias(f"_m_{n}"), F.stddev_pop(c).alias(f"_s_{n}"))]
    out = with_group_stats(df, group, key, stats)
    out = out.withColumns(
        {n: (F.col(c) - F.col(f"_m_{n}")) / F.nullif(F.col(f"_s_{n}"), F.lit(0.0)) for n, c in cols.items()}
    )
    return out.drop("_n", *[f"_{p}_{n}" for n in cols for p in "ms"])


def standardize(df: DataFrame, group, key, cols: Sequence[str]) -> DataFrame:
    """Columns centred and scaled inside a group; a constant column becomes zero."""
    z = zscore(df, group, key, {f"_z_{c}": c for c in cols})
    filled = {c: F.when(F.col(c).isNotNull(), F.coalesce(f"_z_{c}", F.lit(0.0))) for c in cols}
    return z.withColumns(filled).drop(*[f"_z_{c}" for c in cols])


def average_ranks(df: DataFrame, group: str, value: str, key, name: str) -> DataFrame:
    """Rank of each row in its group by ``value``, ties sharing the mean of their ranks.

    Equal values are counted first, so copies cost one row, and only distinct values are sorted.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count(F.lit(1)).alias("_n"))
    before = running_totals(counts, [F.col(group), F.col(value)], {"_before": "_n"})
    start = before.groupBy(group).agg(F.sum("_n").alias("_size"), F.min("_before").alias("_start"))
    placed = attach(before, start, group, value, size="_size")
    rank = F.col("_before") - F.col("_start") + (F.col("_n") + 1) / 2
    ranks = placed.select(group, value, "_n", rank.cast("double").alias(name))
    # A row without a value has no rank, but stays.
    return attach(df, ranks, [group, value], key, how="left").drop("_n")


def group_delta(df: DataFrame, group, key, cols: Sequence[str]) -> DataFrame:
    """Columns ``<c>_diff``: value minus the mean of its group."""
    out = with_group_stats(df, group, key, [F.avg(c).alias(f"_m_{c}") for c in cols])
    return out.withColumns({f"{c}_diff": F.col(c) - F.col(f"_m_{c}") for c in cols}).drop("_n", *[f"_m_{c}" for c in cols])
