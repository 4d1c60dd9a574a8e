"""Mixing sources to target weights: each document is repeated by a Poisson count with its source's mean rate, then all copies are shuffled.

DataFrame functions only. The uniform numbers behind the counts and the order are hashes of (seed, doc_id), so the
result does not depend on how the table is cut. The rates are one row per source and reach the documents by an
ordinary join on (source, salt): Spark broadcasts them after measuring them, and otherwise a hot source is spread
over the salts. The global shuffle needs no sampling pass: the order key is uniform, so its high bits are the partition.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from peerlens.llm.common import aside, table

SEED = 11
#: Means above this are drawn as a sum of equal parts, so that no probability underflows.
PART = 200.0
SALTS = 32
_BITS = 52


def _hash(bits: int, *parts: Column) -> Column:
    """The leading bits of an md5 of the parts as a long; the same in every SQL engine."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[p.cast("string") for p in parts])), 1, bits // 4), 16, 10).cast("long")


def rates(docs: DataFrame, weights: Mapping[str, float] | None = None, default_weight: float = 1.0, epochs: float = 1.0, source_col: str = "source") -> DataFrame:
    """(source, n, rate): how often a document of each source is to occur on average.

    The copies of all sources together are ``epochs`` times the documents, dealt to the sources by weight; a source
    without a weight of its own has ``default_weight``. Null is a source.
    """
    spark = docs.sparkSession
    counts = aside(docs.groupBy(F.col(source_col).alias("source")).agg(F.count("*").alias("n")), "mixing-counts")
    weight: Column = F.lit(float(default_weight))
    if weights:
        given = spark.createDataFrame([(k, float(v)) for k, v in weights.items()], "source string, weight double")
        counts = counts.join(given, counts["source"].eqNullSafe(given["source"]), "left").select(counts["source"], "n", "weight")
        weight = F.coalesce(F.col("weight"), weight)
    counts = counts.select("source", "n", weight.alias("weight"))
    total, mass = counts.agg(F.sum("n"), F.sum("weight")).first()
    share = F.col("weight") * F.lit(float(epochs) * (total or 0) / (mass or 1.0))
    return counts.select("source", "n", (share / F.col("n")).alias("rate"))


def _with_distribution(rate: DataFrame) -> DataFrame:
    """Adds the number of equal parts and the cumulative Poisson probabilities of one part, up to where 1 - 2**-40 is passed."""
    parts = F.greatest(F.lit(1), F.ceil(F.col("rate") / PART)).cast("int")
    mean = F.col("rate") / F.col("parts")
    top = F.ceil(F.col("mean") + 10 * F.sqrt("mean") + 20).cast("int")
    grown = F.aggregate(
        F.sequence(F.lit(1), F.col("top")),
        F.struct(F.exp(-F.col("mean")).alias("p"), F.array(F.exp(-F.col("mean"))).alias("cdf")),
        lambda s, k: F.struct((s["p"] * F.col("mean") / k).alias("p"), F.concat(s["cdf"], F.array(F.element_at(s["cdf"], -1) + s["p"] * F.col("mean") / k)).alias("cdf")),
    )
    return rate.withColumn("parts", parts).withColumn("mean", mean).withColumn("top", top).withColumn("cdf", grown["cdf"])


def mix(docs: DataFrame, weights: Mapping[str, float] | None = None, default_weight: float = 1.0, epochs: float = 1.0, seed: int = SEED, id_col: str = "doc_id", source_col: str = "source", partitions: int | None = None) -> DataFrame:
    """The input's columns, ``copy`` (1 to the count) and ``shuffle_key``; sorted by the key across and inside partitions.

    A document's count is the smallest k whose cumulative probability exceeds its uniform number; a count of zero
    leaves it out, as the target weights ask. Rows with a null id are drawn by their content and, among equal ones, a number, each
    on its own; a null source is a source, empty or long texts are carried along unread. Repeated rows with an id have equal counts
    and keys. Own columns named ``copy`` or ``shuffle_key`` are replaced, all others kept whatever their names.
    """
    docs = docs.drop("copy", "shuffle_key")
    spark = docs.sparkSession
    # The row travels as one struct, so that its columns cannot meet the names used here.
    whole = [F.col(f"_row.`{c}`").alias(c) for c in docs.columns]
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(source_col).alias("_source"), F.col(id_col).cast("string").alias("_id"))
    nameless = packed.where("_id IS NULL")
    if not nameless.isEmpty():
        # Equal rows are counted, not gathered, and numbered again; the number goes by content, not by place in the table.
        counted = nameless.groupBy("_row", "_source").agg(F.count("*").alias("_n")).select("_row", "_source", F.md5(F.to_json("_row")).alias("_content"), F.explode(F.sequence(F.lit(1), F.col("_n"))).alias("_i"))
        numbered = counted.select("_row", "_source", F.concat_ws(" ", F.lit("row"), "_content", "_i").alias("_id"))
        packed = packed.where("_id IS NOT NULL").unionByName(numbered)
    dealt = _with_distribution(rates(docs, weights, default_weight, epochs, source_col)).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = dealt.select(F.struct(F.col("source").alias("s"), "salt").alias("_rate_key"), F.col("parts").alias("_parts"), F.col("cdf").alias("_cdf"))
    keyed = packed.withColumn("_rate_key", F.struct(F.col("_source").alias("s"), F.pmod(F.xxhash64("_id"), F.lit(SALTS)).cast("int").alias("salt")))
    uniform = F.transform(F.sequence(F.lit(0), F.col("_parts") - 1), lambda j: _hash(32, F.lit(seed), j, F.col("_id")) / F.lit(2.0**32))
    count = F.aggregate(uniform, F.lit(0), lambda total, u: total + F.size(F.filter(F.col("_cdf"), lambda c: c <= u)))
    counted = keyed.join(dealt, keyed["_rate_key"].eqNullSafe(dealt["_rate_key"])).select("_row", "_id", count.alias("_count")).where("_count > 0")
    copies = counted.select("_row", "_id", F.explode(F.sequence(F.lit(1), F.col("_count"))).alias("copy"))
    keys = copies.withColumn("shuffle_key", _hash(_BITS, F.lit(seed), F.col("_id"), F.col("copy")))
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    place = F.floor(F.col("shuffle_key") / F.lit(2.0**_BITS) * n).cast("int")
    return keys.repartitionById(n, place).sortWithinPartitions("shuffle_key", "_id", "copy").select(*whole, "copy", "shuffle_key")


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, every source with the same share of the copies, one epoch in all."""
    return mix(table(spark, sf_dir, "documents"))


QUERIES = {"op3_source_mixing": op3_source_mixing}
SQL = {
    "op3_source_mixing": f"""
WITH c AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
r AS (SELECT source, 1.0::DOUBLE * ((SELECT sum(n) FROM c)::DOUBLE / (SELECT count(*) FROM c)::DOUBLE) / n AS rate FROM c),
p AS (SELECT source, greatest(1, ceil(rate / {PART}::DOUBLE))::INT AS parts, rate / greatest(1, ceil(rate / {PART}::DOUBLE)) AS mean FROM r),
k AS (SELECT source, parts, mean, unnest(range(0, 1 + ceil(mean + 10 * sqrt(mean) + 20)::INT)) AS k FROM p),
f AS (SELECT source, k, sum(exp(-mean + k * ln(mean) - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS cdf FROM k),
u AS (SELECT d.doc_id, d.source, ('0x' || substr(md5('{SEED}:' || j || ':' || coalesce(d.doc_id::VARCHAR, '')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u
  FROM (SELECT DISTINCT doc_id, source, parts, unnest(range(0, parts)) AS j FROM documents JOIN p USING (source)) d),
n AS (SELECT u.doc_id, u.source, count(*) AS n FROM u JOIN f ON u.source = f.source AND f.cdf <= u.u GROUP BY ALL),
e AS (SELECT d.*, unnest(range(1, n + 1))::INT AS copy FROM documents d JOIN n USING (doc_id, source))
SELECT *, ('0x' || substr(md5('{SEED}:' || doc_id || ':' || copy), 1, {_BITS // 4}))::BIGINT AS shuffle_key FROM e
"""
}
