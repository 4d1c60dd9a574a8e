"""Joins, top-k and ranking."""

from __future__ import annotations

from pyspark.sql import functions as F

from peerlens.catalog.base import EMB, query, r6, t
from peerlens.catalog.io import TITLE_ABSTRACT_SQL, title_abstract
from peerlens.functions import arrays as A
from peerlens.functions import text as X
from peerlens.operators import grouped as G
from peerlens.operators import knn_index as KI
from peerlens.operators import neighbours as N
from peerlens.operators import rows as W
from peerlens.operators import vectors as V

# Scorer outputs on (order, part) pairs: one scorer knows all pairs, the other two lack some.
PREDS = """
pairs AS (SELECT l_orderkey AS q_id, l_partkey AS pid, l_discount * 10 AS pred1, l_tax * 12.5 AS pred2, l_quantity / 50 AS pred3,
                 l_returnflag, l_linestatus
          FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_partkey ORDER BY l_linenumber, l_suppkey, l_quantity) AS rn FROM lineitem)
          WHERE rn = 1)"""


def pairs(spark, sf):
    li = t(spark, sf, "lineitem").select(
        "l_orderkey", "l_partkey", "l_linenumber", "l_suppkey", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus"
    )
    first = W.keep_first(li, ["l_orderkey", "l_partkey"], [F.col("l_linenumber"), F.col("l_suppkey"), F.col("l_quantity")])
    return first.select(
        F.col("l_orderkey").alias("q_id"),
        F.col("l_partkey").alias("pid"),
        (F.col("l_discount") * 10).alias("pred1"),
        (F.col("l_tax") * 12.5).alias("pred2"),
        (F.col("l_quantity") / 50).alias("pred3"),
        "l_returnflag",
        "l_linestatus",
    )


def scored_pairs(spark, sf):
    p = pairs(spark, sf)
    second = p.where("l_returnflag <> 'R'").select("q_id", "pid", "pred2")
    third = p.where("l_linestatus <> 'F'").select("q_id", "pid", "pred3")
    return W.scores_left(p.select("q_id", "pid", "pred1"), [second, third], ["q_id", "pid"], ["pred1", "pred2", "pred3"])


SCORED = f"""{PREDS}, scored AS (SELECT q_id, pid, pred1, CASE WHEN l_returnflag <> 'R' THEN pred2 ELSE 0 END AS pred2,
  CASE WHEN l_linestatus <> 'F' THEN pred3 ELSE 0 END AS pred3 FROM pairs)"""


@query(
    "join_left_equi",
    """WITH a AS (SELECT text AS answer, conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn
                  FROM conversations WHERE role = 'assistant')
       SELECT c.conv_id, c.turn, c.text, a.answer FROM conversations c LEFT JOIN a ON c.conv_id = a.conv_id AND a.rn = 1
       WHERE c.role = 'user'""",
)
def join_left_equi(spark, sf):
    c = t(spark, sf, "conversations")
    answers = c.where("role = 'assistant'").select("conv_id", F.col("turn").alias("_t"), F.col("text").alias("answer"))
    first = W.keep_first(answers, "conv_id", [F.col("_t")]).drop("_t")
    return c.where("role = 'user'").select("conv_id", "turn", "text").join(first, "conv_id", "left")


@query(
    "join_lookup_diff_keys",
    """SELECT l_orderkey, l_linenumber, l_partkey, p_brand, p_type FROM lineitem LEFT JOIN part ON l_partkey = p_partkey""",
)
def join_lookup_diff_keys(spark, sf):
    li = t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    p = t(spark, sf, "part").select("p_partkey", "p_brand", "p_type")
    return li.join(p, li.l_partkey == p.p_partkey, "left").drop("p_partkey")


# Eleven per-order features, each its own table that lacks the orders its condition leaves out.
FEATURES = {
    "f1": ("sum(l_quantity)", "l_returnflag = 'R'"),
    "f2": ("sum(l_quantity)", "l_returnflag = 'A'"),
    "f3": ("sum(l_quantity)", "l_returnflag = 'N'"),
    "f4": ("max(l_discount)", "l_linestatus = 'F'"),
    "f5": ("max(l_discount)", "l_linestatus = 'O'"),
    "f6": ("min(l_tax)", "l_quantity > 10"),
    "f7": ("max(l_tax)", "l_quantity > 20"),
    "f8": ("count(*)", "l_quantity > 30"),
    "f9": ("count(*)", "l_discount > 0.05"),
    "f10": ("min(l_linenumber)", "l_tax > 0.02"),
    "f11": ("max(l_linenumber)", "l_tax < 0.05"),
}


@query(
    "join_feature_wide",
    "SELECT o.o_custkey AS author_id, o.o_orderkey AS paper_id, " + ", ".join(FEATURES) + " FROM orders o "
    + " ".join(
        f"LEFT JOIN (SELECT l_orderkey, {e} AS {n} FROM lineitem WHERE {w} GROUP BY l_orderkey) t{n} ON t{n}.l_orderkey = o.o_orderkey"
        for n, (e, w) in FEATURES.items()
    ),
)
def join_feature_wide(spark, sf):
    ids = t(spark, sf, "orders").select(F.col("o_custkey").alias("author_id"), F.col("o_orderkey").alias("paper_id"))
    li = t(spark, sf, "lineitem")
    tables = [
        li.where(w).groupBy(F.col("l_orderkey").alias("paper_id")).agg(F.expr(e).alias(n)) for n, (e, w) in FEATURES.items()
    ]
    return W.wide_features(ids, tables, ["paper_id"])


@query(
    "join_index_align",
    """SELECT d.doc_id, d.n_chars, l.quality, l.toxic FROM documents d JOIN labels l ON d.doc_id = l.doc_id""",
)
def join_index_align(spark, sf):
    return t(spark, sf, "documents").select("doc_id", "n_chars").join(t(spark, sf, "labels"), "doc_id")


@query(
    "join_concat_horizontal",
    """WITH a AS (SELECT o_orderkey, o_custkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS pos FROM orders),
            b AS (SELECT c_custkey, c_acctbal, row_number() OVER (ORDER BY c_custkey) - 1 AS pos FROM customer)
       SELECT a.pos, o_orderkey, o_custkey, c_custkey, c_acctbal FROM a LEFT JOIN b ON a.pos = b.pos""",
)
def join_concat_horizontal(spark, sf):
    a = G.row_positions(t(spark, sf, "orders").select("o_orderkey", "o_custkey"), [F.col("o_orderkey")])
    b = G.row_positions(t(spark, sf, "customer").select("c_custkey", "c_acctbal"), [F.col("c_custkey")])
    return a.join(b, "pos", "left")


@query(
    "join_semi",
    "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag <> 'R' AND l_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')",
)
def join_semi(spark, sf):
    li = t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")
    pos = li.where("l_returnflag = 'R'").select("l_orderkey").distinct()
    return li.where("l_returnflag <> 'R'").join(pos, "l_orderkey", "left_semi").drop("l_returnflag")


@query(
    "join_anti",
    "SELECT o_orderkey, o_custkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l_quantity > 45)",
)
def join_anti(spark, sf):
    old = t(spark, sf, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"))
    return t(spark, sf, "orders").select("o_orderkey", "o_custkey").join(old, "o_orderkey", "left_anti")


@query(
    "join_self_pairs",
    f"""WITH {EMB} SELECT a.label, a.vec_id, count(b.vec_id) AS n_pairs,
               {r6("coalesce(sum(list_cosine_similarity(a.v, b.v)), 0)")} AS pair_sum
        FROM emb a LEFT JOIN emb b ON a.label = b.label AND a.vec_id <> b.vec_id GROUP BY a.label, a.vec_id""",
)
def join_self_pairs(spark, sf):
    s = V.pair_sums(t(spark, sf, "embeddings"), "label", "vec_id", "embedding")
    return s.withColumn("pair_sum", A.r6("pair_sum"))


KNN = f"""WITH {EMB}, s AS (SELECT a.vec_id, b.vec_id AS item, {r6("list_cosine_similarity(a.v, b.v)")} AS score
                            FROM emb a JOIN emb b ON a.vec_id <> b.vec_id),
          r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, item) AS rank FROM s)
          SELECT vec_id, item, score, rank FROM r"""


@query("join_knn_cosine", KNN + " WHERE rank <= 5 AND score >= 0.3")
def join_knn_cosine(spark, sf):
    e = t(spark, sf, "embeddings")
    return N.knn_cosine(e, e, "vec_id", "vec_id", "embedding", "embedding", 5, skip_same=True, min_score=0.3)


@query("topk_knn_index")
def topk_knn_index(spark, sf):
    e = t(spark, sf, "embeddings")
    return KI.knn_index(e, e, "vec_id", "vec_id", "embedding", "embedding", 10, skip_same=True)


@query("knn_index_recall", "SELECT count(*) AS queries, true AS found_nine_tenths, true AS scores_equal FROM embeddings")
def knn_index_recall(spark, sf):
    """Neighbours of the index against the exact ones: the share found, and whether the scores of those are the same."""
    exact = topk_knn(spark, sf).select("vec_id", "item", F.col("score").alias("exact"))
    both = exact.join(topk_knn_index(spark, sf), ["vec_id", "item"], "left")
    hit = F.col("score").isNotNull()
    return both.agg(
        F.countDistinct("vec_id").alias("queries"),
        (F.sum(hit.cast("int")) >= 0.9 * F.count(F.lit(1))).alias("found_nine_tenths"),
        F.min(~hit | (F.col("score") == F.col("exact"))).alias("scores_equal"),
    )


@query("topk_knn", KNN + " WHERE rank <= 10")
def topk_knn(spark, sf):
    e = t(spark, sf, "embeddings")
    return N.knn_cosine(e, e, "vec_id", "vec_id", "embedding", "embedding", 10, skip_same=True)


@query(
    "join_label_membership",
    f"""WITH {PREDS} SELECT q_id, pid, CASE WHEN EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = q_id AND l_partkey = pid AND l_quantity > 25)
        THEN 1 ELSE 0 END AS target FROM pairs""",
)
def join_label_membership(spark, sf):
    truth = t(spark, sf, "lineitem").where("l_quantity > 25").select(F.col("l_orderkey").alias("q_id"), F.col("l_partkey").alias("pid"))
    return W.label_membership(pairs(spark, sf).select("q_id", "pid"), truth, ["q_id", "pid"])


@query(
    "join_text_lookup",
    f"""WITH {TITLE_ABSTRACT_SQL} SELECT l.doc_id, l.quality, '<title> ' || title || ' <abstract> ' || abstract AS title_abstract
        FROM labels l LEFT JOIN docs ON l.doc_id = docs.doc_id""",
)
def join_text_lookup(spark, sf):
    d = title_abstract(t(spark, sf, "documents"))
    text = d.select("doc_id", F.concat_ws(" ", X.tagged("title", F.col("title")), X.tagged("abstract", F.col("abstract"))).alias("title_abstract"))
    return t(spark, sf, "labels").select("doc_id", "quality").join(text, "doc_id", "left")


@query(
    "join_scores_left",
    f"WITH {SCORED} SELECT q_id, pid, {r6('pred1')} AS pred1, {r6('pred2')} AS pred2, {r6('pred3')} AS pred3 FROM scored",
)
def join_scores_left(spark, sf):
    s = scored_pairs(spark, sf)
    return s.select("q_id", "pid", *[A.r6(c).alias(c) for c in ("pred1", "pred2", "pred3")])


@query(
    "join_fold_preds",
    f"""SELECT o_custkey, o_orderkey, {r6("ln(o_totalprice) / 20")} AS pred_0, {r6("ln(o_totalprice) / 30")} AS pred_1,
               CASE WHEN o_orderstatus = 'F' THEN {r6("ln(o_totalprice) / 40")} END AS pred_2 FROM orders""",
)
def join_fold_preds(spark, sf):
    o = t(spark, sf, "orders")
    keys = ["o_custkey", "o_orderkey"]
    fold = lambda d, i, by: d.select(*keys, A.r6(F.log("o_totalprice") / by).alias(f"pred_{i}"))
    return W.wide_features(fold(o, 0, 20), [fold(o, 1, 30), fold(o.where("o_orderstatus = 'F'"), 2, 40)], keys)


# ---- ranking -------------------------------------------------------------------------------------


@query(
    "topk_candidates",
    """WITH best AS (SELECT o_custkey, l_partkey, min(l_linenumber * 1000000 - l_quantity * 1000) AS position
                     FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_custkey, l_partkey),
            r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY position, l_partkey) AS rank FROM best)
       SELECT o_custkey, l_partkey, position, rank FROM r WHERE rank <= 100""",
)
def topk_candidates(spark, sf):
    li = t(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity")
    o = t(spark, sf, "orders").select("o_orderkey", "o_custkey")
    listed = li.join(o, li.l_orderkey == o.o_orderkey)
    position = F.min(F.col("l_linenumber") * 1000000 - F.col("l_quantity") * 1000)
    best = listed.groupBy("o_custkey", "l_partkey").agg(position.alias("position"))
    return N.top_per_key(best, "o_custkey", [F.col("position"), F.col("l_partkey")], 100)


@query(
    "rank_per_group",
    f"""WITH {PREDS} SELECT q_id, pid, {r6('pred3')} AS score,
               row_number() OVER (PARTITION BY q_id ORDER BY {r6('pred3')} DESC, pid) AS rank FROM pairs""",
)
def rank_per_group(spark, sf):
    p = pairs(spark, sf).select("q_id", "pid", A.r6("pred3").alias("score"))
    return G.group_ranks(p, "q_id", [F.desc("score"), F.col("pid")], "pid").drop("_n")


@query(
    "topk_final",
    """WITH r AS (SELECT o_custkey, o_orderkey, o_totalprice,
                         row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders)
       SELECT o_custkey, o_orderkey, o_totalprice, rank FROM r WHERE rank <= 20""",
)
def topk_final(spark, sf):
    o = t(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return N.top_per_key(o, "o_custkey", [F.desc("o_totalprice"), F.col("o_orderkey")], 20)


@query("sort_global", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey")
def sort_global(spark, sf):
    return t(spark, sf, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey")


@query(
    "win_zscore",
    f"""SELECT o_custkey, o_orderkey, {r6("(o_totalprice - avg(o_totalprice) OVER w) / nullif(stddev_pop(o_totalprice) OVER w, 0)")} AS z
        FROM orders WINDOW w AS (PARTITION BY o_custkey)""",
)
def win_zscore(spark, sf):
    return G.zscore(t(spark, sf, "orders"), "o_custkey", "o_orderkey", {"z": "o_totalprice"}).select(
        "o_custkey", "o_orderkey", A.r6("z").alias("z")
    )


@query(
    "win_standardize",
    f"""SELECT o_custkey, o_orderkey,
               {r6("(o_totalprice - avg(o_totalprice) OVER w) / CASE WHEN coalesce(stddev_pop(o_totalprice) OVER w, 0) = 0 THEN 1 ELSE stddev_pop(o_totalprice) OVER w END")} AS price,
               {r6("(year(o_orderdate) - avg(year(o_orderdate)) OVER w) / CASE WHEN stddev_pop(year(o_orderdate)) OVER w = 0 THEN 1 ELSE stddev_pop(year(o_orderdate)) OVER w END")} AS year
        FROM orders WINDOW w AS (PARTITION BY o_custkey)""",
)
def win_standardize(spark, sf):
    o = t(spark, sf, "orders").select("o_custkey", "o_orderkey", F.col("o_totalprice").alias("price"), F.year("o_orderdate").alias("year"))
    return G.standardize(o, "o_custkey", "o_orderkey", ["price", "year"]).select(
        "o_custkey", "o_orderkey", A.r6("price").alias("price"), A.r6("year").alias("year")
    )


@query(
    "win_rank_avg",
    """SELECT doc_id, source, CAST(rank() OVER (PARTITION BY source ORDER BY n_chars) + (count(*) OVER (PARTITION BY source, n_chars) - 1) / 2.0 AS DOUBLE) AS avg_rank
       FROM documents""",
)
def win_rank_avg(spark, sf):
    d = t(spark, sf, "documents").select("doc_id", "source", "n_chars")
    return G.average_ranks(d, "source", "n_chars", "doc_id", "avg_rank").select("doc_id", "source", "avg_rank")
