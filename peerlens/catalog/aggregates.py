"""Aggregations, vector statistics and set scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from peerlens.catalog.base import EMB, query, r6, t
from peerlens.functions import arrays as A
from peerlens.operators import grouped as G
from peerlens.operators import neighbours as N
from peerlens.operators import vectors as V

ROW_STATS_SQL = f"""{EMB}, x AS (SELECT vec_id, label, unnest(v) AS c FROM emb),
rs AS (SELECT vec_id, label, avg(c) AS mean, quantile_cont(c, 0.5) AS median, max(c) AS max, min(c) AS min, stddev_samp(c) AS std,
              var_samp(c) AS var, quantile_cont(c, 0.25) AS q25, quantile_cont(c, 0.75) AS q75 FROM x GROUP BY vec_id, label)"""
PAIR_STATS_SQL = f"""{EMB}, p AS (SELECT a.label, a.vec_id, CASE WHEN a.vec_id = b.vec_id THEN 0 ELSE list_cosine_similarity(a.v, b.v) END AS c
                         FROM emb a JOIN emb b ON a.label = b.label),
rs AS (SELECT label, vec_id, avg(c) AS mean, quantile_cont(c, 0.5) AS median, max(c) AS max, min(c) AS min, stddev_samp(c) AS std,
              var_samp(c) AS var, quantile_cont(c, 0.25) AS q25, quantile_cont(c, 0.75) AS q75 FROM p GROUP BY label, vec_id)"""


def stats_cols_sql(prefix: str) -> str:
    return ", ".join(f"{r6(s)} AS {prefix}_{s}" for s in V.STATS)


def _moments(cols: list[str]) -> tuple[str, str, str, str]:
    n = len(cols)
    mean = "((" + " + ".join(cols) + f") / {n})"
    return tuple([mean] + ["((" + " + ".join(f"power({c} - {mean}, {k})" for c in cols) + f") / {n})" for k in (2, 3, 4)])


def shape_sql(source: str, prefix: str, keys: str) -> str:
    """Skewness of the ten summary columns, then kurtosis of the eleven."""
    ten = V.STATS + ["rng", "iqr"]
    _, m2, m3, _ = _moments(ten)
    _, k2, _, k4 = _moments(ten + ["skew"])
    return f"""s10 AS (SELECT *, max - min AS rng, q75 - q25 AS iqr FROM {source}),
s11 AS (SELECT *, {m3} / nullif(power({m2}, 1.5), 0) AS skew FROM s10)
SELECT {keys}, {r6('rng')} AS {prefix}_range, {r6('iqr')} AS {prefix}_iqr, {r6('skew')} AS {prefix}_skew,
       {r6(f'{k4} / nullif(power({k2}, 2), 0) - 3')} AS {prefix}_kurtosis FROM s11"""


def _rounded(df, keys, cols):
    return df.select(*keys, *[A.r6(c).alias(c) for c in cols])


@query(
    "agg_collect_list",
    """WITH r AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders)
       SELECT o_custkey, (rn - 1) // 1000 AS part, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY rn) AS items, count(*) AS n FROM r GROUP BY ALL""",
)
def agg_collect_list(spark, sf):
    o = t(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    # The whole list of a key, in ordered parts of bounded size.
    placed = G.group_ranks(o, "o_custkey", [F.col("o_orderdate"), F.col("o_orderkey")], "o_orderkey")
    ordered = F.sort_array(F.collect_list(F.struct("rank", F.col("o_orderkey").cast("string").alias("i"))))
    part = F.floor((F.col("rank") - 1) / 1000).alias("part")
    lists = placed.groupBy("o_custkey", part).agg(ordered.alias("l"), F.count(F.lit(1)).alias("n"))
    return lists.select("o_custkey", "part", F.array_join(F.transform("l", lambda x: x["i"]), ",").alias("items"), "n")


@query(
    "agg_count_distinct",
    """SELECT l_returnflag, count(DISTINCT l_orderkey) AS queries, count(DISTINCT l_partkey) AS items, count(*) AS n FROM lineitem GROUP BY l_returnflag""",
)
def agg_count_distinct(spark, sf):
    return t(spark, sf, "lineitem").groupBy("l_returnflag").agg(
        F.count_distinct("l_orderkey").alias("queries"), F.count_distinct("l_partkey").alias("items"), F.count(F.lit(1)).alias("n")
    )


@query("agg_row_stats", f"WITH {ROW_STATS_SQL} SELECT vec_id, {stats_cols_sql('vec')} FROM rs")
def agg_row_stats(spark, sf):
    s = V.row_stats(t(spark, sf, "embeddings"), "embedding", "vec")
    return _rounded(s, ["vec_id"], [f"vec_{x}" for x in V.STATS])


@query("agg_pair_stats", f"WITH {PAIR_STATS_SQL} SELECT label, vec_id, {stats_cols_sql('cos')} FROM rs")
def agg_pair_stats(spark, sf):
    s = V.pair_stats(t(spark, sf, "embeddings"), "label", "vec_id", "embedding", "cos")
    return _rounded(s, ["label", "vec_id"], [f"cos_{x}" for x in V.STATS])


@query(
    "agg_range_iqr",
    f"WITH {ROW_STATS_SQL} SELECT vec_id, {r6('max - min')} AS vec_range, {r6('q75 - q25')} AS vec_iqr FROM rs",
)
def agg_range_iqr(spark, sf):
    s = V.with_range_iqr(V.row_stats(t(spark, sf, "embeddings"), "embedding", "vec"), "vec")
    return _rounded(s, ["vec_id"], ["vec_range", "vec_iqr"])


@query("agg_summary_shape", f"WITH {PAIR_STATS_SQL}, {shape_sql('rs', 'cos', 'label, vec_id')}")
def agg_summary_shape(spark, sf):
    s = V.pair_stats(t(spark, sf, "embeddings"), "label", "vec_id", "embedding", "cos")
    s = V.with_summary_shape(V.with_range_iqr(s, "cos"), "cos")
    return _rounded(s, ["label", "vec_id"], ["cos_range", "cos_iqr", "cos_skew", "cos_kurtosis"])


@query(
    "agg_centroid",
    f"""WITH {EMB}, x AS (SELECT label, unnest(v) AS c, generate_subscripts(v, 1) - 1 AS dim FROM emb)
        SELECT label, dim, {r6("avg(c)")} AS value FROM x GROUP BY label, dim""",
)
def agg_centroid(spark, sf):
    c = V.centroids(t(spark, sf, "embeddings"), "label", "embedding")
    return c.select("label", F.posexplode("centroid").alias("dim", "value")).select(
        "label", F.col("dim").cast("long").alias("dim"), A.r6("value").alias("value")
    )


ORDER_FACTS = """facts AS (SELECT o_custkey, o_orderkey, year(o_orderdate) AS year, count(l_linenumber) AS lines,
       coalesce(sum(l_quantity), 0) AS quantity, count(DISTINCT l_suppkey) AS suppliers
  FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_custkey, o_orderkey, year(o_orderdate))"""


def order_facts(spark, sf):
    o = t(spark, sf, "orders").select("o_custkey", "o_orderkey", F.year("o_orderdate").alias("year"))
    li = t(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.count(F.lit(1)).alias("lines"), F.sum("l_quantity").alias("quantity"), F.count_distinct("l_suppkey").alias("suppliers")
    )
    return o.join(li, "o_orderkey", "left").na.fill(0, ["lines", "quantity", "suppliers"])


_FACTS = ["year", "lines", "quantity", "suppliers"]


@query(
    "agg_group_delta",
    f"WITH {ORDER_FACTS} SELECT o_custkey, o_orderkey, "
    + ", ".join(f"{r6(f'{c} - avg({c}) OVER (PARTITION BY o_custkey)')} AS {c}_diff" for c in _FACTS) + " FROM facts",
)
def agg_group_delta(spark, sf):
    d = G.group_delta(order_facts(spark, sf), "o_custkey", "o_orderkey", _FACTS)
    return _rounded(d, ["o_custkey", "o_orderkey"], [f"{c}_diff" for c in _FACTS])


@query(
    "agg_negative_count",
    """SELECT o_custkey, CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 1 END) AS BIGINT) AS negatives,
              CAST((SELECT sum(CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 1 END) FROM orders) AS BIGINT) AS all_negatives FROM orders GROUP BY o_custkey""",
)
def agg_negative_count(spark, sf):
    o = t(spark, sf, "orders").select("o_custkey", (F.col("o_orderstatus") != "F").cast("long").alias("neg"))
    per = o.groupBy("o_custkey").agg(F.sum("neg").alias("negatives"))
    everything = o.agg(F.sum("neg").alias("all_negatives")).withColumn("_one", F.lit(1))
    return per.withColumn("_one", F.lit(1)).join(everything, "_one").drop("_one")


@query(
    "vec_cosine",
    f"""WITH {EMB} SELECT vec_id, {r6("list_cosine_similarity(v, list_reverse(v))")} AS cos FROM emb""",
)
def vec_cosine(spark, sf):
    v = A.doubles("embedding")
    return t(spark, sf, "embeddings").select("vec_id", A.r6(A.cosine(v, F.reverse(v))).alias("cos"))


CENTROID_SQL = f"""{EMB}, x AS (SELECT label, unnest(v) AS c, generate_subscripts(v, 1) AS dim FROM emb),
m AS (SELECT label, list(a ORDER BY dim) AS centroid FROM (SELECT label, dim, avg(c) AS a FROM x GROUP BY label, dim) GROUP BY label)"""


@query(
    "vec_cos_to_centroid",
    f"""WITH {CENTROID_SQL} SELECT e.label, e.vec_id, {r6("list_cosine_similarity(e.v, m.centroid)")} AS cos_author
        FROM emb e JOIN m ON e.label = m.label""",
)
def vec_cos_to_centroid(spark, sf):
    c = V.cos_to_centroid(t(spark, sf, "embeddings"), "label", "vec_id", "embedding", "cos_author")
    return c.withColumn("cos_author", A.r6("cos_author"))


@query(
    "vec_cos_mean_linear",
    f"""WITH {EMB} SELECT a.label, a.vec_id, {r6("avg(CASE WHEN a.vec_id = b.vec_id THEN 0 ELSE list_cosine_similarity(a.v, b.v) END)")} AS cos_mean
        FROM emb a JOIN emb b ON a.label = b.label GROUP BY a.label, a.vec_id""",
)
def vec_cos_mean_linear(spark, sf):
    m = V.cos_mean_linear(t(spark, sf, "embeddings"), "label", "vec_id", "embedding", "cos_mean")
    return m.withColumn("cos_mean", A.r6("cos_mean"))


@query(
    "vec_l2_normalize",
    f"""WITH x AS (SELECT c_custkey, c_acctbal AS a, CAST(c_nationkey AS DOUBLE) AS b FROM customer)
        SELECT c_custkey, {r6("CASE WHEN sqrt(a*a+b*b) = 0 THEN 0 ELSE a / sqrt(a*a+b*b) END")} AS x,
               {r6("CASE WHEN sqrt(a*a+b*b) = 0 THEN 0 ELSE b / sqrt(a*a+b*b) END")} AS y FROM x""",
)
def vec_l2_normalize(spark, sf):
    u = A.unit(F.array(F.col("c_acctbal"), F.col("c_nationkey").cast("double")))
    return t(spark, sf, "customer").select("c_custkey", u.alias("u")).select(
        "c_custkey", A.r6(F.col("u")[0]).alias("x"), A.r6(F.col("u")[1]).alias("y")
    )


@query(
    "vec_masked_mean",
    f"""WITH {EMB}, x AS (SELECT label, vec_id, unnest(v) AS c, generate_subscripts(v, 1) - 1 AS dim FROM emb)
        SELECT label, dim, {r6("sum(CASE WHEN c > 0 THEN c ELSE 0 END) / greatest(sum(CASE WHEN c > 0 THEN 1 ELSE 0 END), 1e-9)")} AS value
        FROM x GROUP BY label, dim""",
)
def vec_masked_mean(spark, sf):
    e = t(spark, sf, "embeddings").select("label", F.posexplode(A.doubles("embedding")).alias("dim", "c"))
    m = V.masked_mean(e.withColumn("m", F.col("c") > 0), ["label", "dim"], "c", "m", "value")
    return m.select("label", F.col("dim").cast("long").alias("dim"), A.r6("value").alias("value"))


@query(
    "dense_features",
    f"""WITH {EMB}, x AS (SELECT label, vec_id, unnest(v) AS c FROM emb),
        p AS (SELECT a.label, a.vec_id, CASE WHEN a.vec_id = b.vec_id THEN 0 ELSE list_cosine_similarity(a.v, b.v) END AS c
              FROM emb a JOIN emb b ON a.label = b.label),
        v AS (SELECT label, vec_id, avg(c) AS v_mean, stddev_samp(c) AS v_std, quantile_cont(c, 0.75) - quantile_cont(c, 0.25) AS v_iqr FROM x GROUP BY label, vec_id),
        k AS (SELECT label, vec_id, avg(c) AS c_mean, max(c) - min(c) AS c_range, quantile_cont(c, 0.5) AS c_median FROM p GROUP BY label, vec_id),
        cx AS (SELECT label, unnest(v) AS c, generate_subscripts(v, 1) AS dim FROM emb),
        m AS (SELECT label, list(a ORDER BY dim) AS centroid FROM (SELECT label, dim, avg(c) AS a FROM cx GROUP BY label, dim) GROUP BY label)
        SELECT e.label, e.vec_id, {r6('v_mean')} AS e_vec_mean, {r6('v_std')} AS e_vec_std, {r6('v_iqr')} AS e_vec_iqr,
               {r6('c_mean')} AS e_cos_mean, {r6('c_range')} AS e_cos_range, {r6('c_median')} AS e_cos_median,
               {r6('list_cosine_similarity(e.v, m.centroid)')} AS e_cos_author
        FROM emb e JOIN v USING (label, vec_id) JOIN k USING (label, vec_id) JOIN m ON e.label = m.label""",
)
def dense_features(spark, sf):
    f = V.dense_stats(t(spark, sf, "embeddings"), "label", "vec_id", "embedding", "e")
    cols = ["e_vec_mean", "e_vec_std", "e_vec_iqr", "e_cos_mean", "e_cos_range", "e_cos_median", "e_cos_author"]
    return _rounded(f, ["label", "vec_id"], cols)
