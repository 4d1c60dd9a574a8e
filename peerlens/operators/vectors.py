"""Vector columns described on their own and relative to the other vectors of their group."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peerlens.functions import arrays as A
from peerlens.operators.grouped import attach
from peerlens.operators.tiles import TILE_ROWS, pair_moments, pair_quantiles, tiled

STATS = ["mean", "median", "max", "min", "std", "var", "q25", "q75"]
QUANTILES = {"q25": 0.25, "median": 0.5, "q75": 0.75}


def row_stats(df: DataFrame, vec: str, prefix: str) -> DataFrame:
    """The eight statistics of each vector over its own components (sample std and var)."""
    v = A.doubles(vec)
    s = F.col("_s")
    m = F.col("_m")
    var = F.aggregate("_s", F.lit(0.0), lambda t, x: t + (x - m) * (x - m)) / F.nullif(F.size("_s") - 1, F.lit(0))
    named = {
        "mean": m,
        "median": A.sorted_quantile(s, 0.5),
        "max": F.array_max("_s"),
        "min": F.array_min("_s"),
        "std": F.sqrt(var),
        "var": var,
        "q25": A.sorted_quantile(s, 0.25),
        "q75": A.sorted_quantile(s, 0.75),
    }
    return (
        df.withColumn("_s", F.sort_array(v))
        .withColumn("_m", A.total("_s") / F.size("_s"))
        .withColumns({f"{prefix}_{k}": c for k, c in named.items()})
        .drop("_s", "_m")
    )


def pair_stats(
    df: DataFrame, group: str, key: str, vec: str, prefix: str, *, tile_rows: int = TILE_ROWS
) -> DataFrame:
    """The eight statistics of each row's cosines to its group; the row itself counts as one zero."""
    rows = df.select(group, key, A.doubles(vec).alias(vec))
    tiles = tiled(rows, group, key, tile_rows=tile_rows)
    base = pair_moments(tiles, group, key, vec, ranks=QUANTILES)
    full = pair_quantiles(tiles, group, key, vec, base, QUANTILES, measure="cos", diagonal=0.0)
    n, s, ss = F.col("_cnt"), F.col("_sum"), F.col("_ssq")
    var = F.greatest(ss - s * s / n, F.lit(0.0)) / F.nullif(n - 1, F.lit(0))
    named = {
        "mean": s / n,
        "median": F.col("median"),
        "max": F.col("_max"),
        "min": F.col("_min"),
        "std": F.sqrt(var),
        "var": var,
        "q25": F.col("q25"),
        "q75": F.col("q75"),
    }
    return full.select(group, key, *[c.alias(f"{prefix}_{k}") for k, c in named.items()])


def pair_sums(df: DataFrame, group: str, key: str, vec: str, *, measure: str = "cos", tile_rows: int = TILE_ROWS):
    """Per row: number of ordered pairs with the others of its group, and the sum of the pair measure."""
    tiles = tiled(df.select(group, key, A.doubles(vec).alias(vec)), group, key, tile_rows=tile_rows)
    m = pair_moments(tiles, group, key, vec, measure=measure, diagonal=None)
    return m.select(group, key, F.col("_cnt").alias("n_pairs"), F.col("_sum").alias("pair_sum"))


def with_range_iqr(df: DataFrame, prefix: str) -> DataFrame:
    return df.withColumns(
        {
            f"{prefix}_range": F.col(f"{prefix}_max") - F.col(f"{prefix}_min"),
            f"{prefix}_iqr": F.col(f"{prefix}_q75") - F.col(f"{prefix}_q25"),
        }
    )


def with_summary_shape(df: DataFrame, prefix: str) -> DataFrame:
    """Skewness over the ten summary columns of a row, then kurtosis over those ten and the skewness."""
    ten = [f"{prefix}_{s}" for s in STATS + ["range", "iqr"]]
    out = df.withColumn(f"{prefix}_skew", A.skewness(F.array(*[F.col(c) for c in ten])))
    eleven = F.array(*[F.col(c) for c in ten + [f"{prefix}_skew"]])
    return out.withColumn(f"{prefix}_kurtosis", A.kurtosis(eleven))


def mean_vector(vec, weight: Column | None = None) -> Column:
    """Aggregate: component-wise mean of an array column, combined map-side."""
    v = array_to_vector(A.doubles(vec))
    return vector_to_array(Summarizer.mean(v, weight) if weight is not None else Summarizer.mean(v))


def centroids(df: DataFrame, group: str, vec: str) -> DataFrame:
    """One row per group: size ``_n`` and ``centroid``."""
    return df.groupBy(group).agg(F.count(F.lit(1)).alias("_n"), mean_vector(vec).alias("centroid"))


def cos_to_centroid(df: DataFrame, group: str, key: str, vec: str, name: str) -> DataFrame:
    rows = df.select(group, key, A.doubles(vec).alias("_v"))
    return attach(rows, centroids(rows, group, "_v"), group, key).select(
        group, key, A.cosine("_v", "centroid").alias(name)
    )


def cos_mean_linear(df: DataFrame, group: str, key: str, vec: str, name: str) -> DataFrame:
    """Mean cosine to the group (own zero included) from the sum of unit vectors: no pairs at all.

    The mean is over the cosines that exist: a vector without length has none but its own zero, and
    is nobody's partner.
    """
    rows = df.select(group, key, A.unit(A.doubles(vec)).alias("_u"))
    rows = rows.withColumn("_ok", (A.dot("_u", "_u") > 0).cast("int"))
    stats = rows.groupBy(group).agg(
        F.count(F.lit(1)).alias("_n"), F.sum("_ok").alias("_live"), mean_vector("_u").alias("_mean")
    )
    summed = A.dot("_u", "_mean") * F.col("_n")
    value = F.when(F.col("_ok") == 1, (summed - 1) / F.col("_live")).otherwise(F.lit(0.0))
    return attach(rows, stats, group, key).select(group, key, value.alias(name))


def masked_mean(df: DataFrame, keys: list[str], value: str, mask: str, name: str) -> DataFrame:
    """Mean of the masked-in values, with a denominator of at least 1e-9."""
    m = F.col(mask).cast("double")
    return df.groupBy(*keys).agg(
        (F.sum(F.col(value) * m) / F.greatest(F.sum(m), F.lit(1e-9))).alias(name)
    )


def dense_stats(df: DataFrame, group: str, key: str, vec: str, prefix: str, *, tile_rows: int = TILE_ROWS) -> DataFrame:
    """Component statistics, cosine statistics, their shape, and the cosine to the centroid."""
    own = row_stats(df.select(group, key, vec), vec, f"{prefix}_vec").drop(vec)
    own = with_summary_shape(with_range_iqr(own, f"{prefix}_vec"), f"{prefix}_vec")
    pair = pair_stats(df, group, key, vec, f"{prefix}_cos", tile_rows=tile_rows)
    pair = with_summary_shape(with_range_iqr(pair, f"{prefix}_cos"), f"{prefix}_cos")
    centre = cos_to_centroid(df, group, key, vec, f"{prefix}_cos_author")
    return own.join(pair, [group, key]).join(centre, [group, key])
