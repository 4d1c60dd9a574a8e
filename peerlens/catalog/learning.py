"""Splits, samples, metrics, ensembles and models."""

from __future__ import annotations

from pyspark.sql import functions as F

from peerlens.catalog.aggregates import order_facts
from peerlens.catalog.base import query, r6, sql_hash, t
from peerlens.catalog.joins import SCORED, scored_pairs
from peerlens.functions import arrays as A
from peerlens.functions import text as X
from peerlens.functions.hashing import portable_hash
from peerlens.operators import features as FE
from peerlens.operators import grouped as G
from peerlens.operators import metrics as M
from peerlens.operators import models as MD
from peerlens.operators import neighbours as N
from peerlens.operators import splits as SP
from peerlens.runtime import spread

# ---- splits --------------------------------------------------------------------------------------


@query(
    "smp_group_kfold",
    f"""WITH c AS (SELECT o_custkey, (row_number() OVER (ORDER BY {sql_hash(42, 'o_custkey')}, o_custkey) - 1) % 4 AS fold FROM (SELECT DISTINCT o_custkey FROM orders))
        SELECT o.o_orderkey, o.o_custkey, fold, {sql_hash(42, 'o.o_custkey')} % 4 AS hash_fold FROM orders o JOIN c ON o.o_custkey = c.o_custkey""",
)
def smp_group_kfold(spark, sf):
    o = t(spark, sf, "orders").select("o_orderkey", "o_custkey")
    return SP.group_kfold(SP.group_kfold(o, "o_custkey", 4), "o_custkey", 4, balanced=False, name="hash_fold")


@query(
    "smp_group_shuffle",
    f"SELECT o_orderkey, CAST({sql_hash(85, 'o_custkey')} / 4294967296.0::DOUBLE < 0.3 AS INTEGER) AS is_test FROM orders",
)
def smp_group_shuffle(spark, sf):
    return SP.group_shuffle(t(spark, sf, "orders"), "o_custkey").select("o_orderkey", "is_test")


_RANKED = "(row_number() OVER (PARTITION BY o_orderstatus ORDER BY {h}, o_orderkey) - 1)"


@query(
    "smp_stratified_split",
    f"""SELECT o_orderkey, o_orderstatus, CAST({_RANKED.format(h=sql_hash(1, 'o_orderkey'))} < floor(count(*) OVER (PARTITION BY o_orderstatus) * CAST(0.1 AS DOUBLE)) AS INTEGER) AS is_valid
        FROM orders""",
)
def smp_stratified_split(spark, sf):
    return SP.stratified_split(t(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus", "o_orderkey")


@query(
    "smp_stratified_kfold",
    f"SELECT o_orderkey, o_orderstatus, {_RANKED.format(h=sql_hash(92, 'o_orderkey'))} % 5 AS fold FROM orders",
)
def smp_stratified_kfold(spark, sf):
    return SP.stratified_kfold(t(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus", "o_orderkey")


@query(
    "smp_negative_downsample",
    f"""WITH x AS (SELECT o_custkey AS q_id, o_orderkey AS pid, CAST(o_orderpriority = '1-URGENT' AS INTEGER) AS target FROM orders)
        SELECT q_id, pid, target FROM x WHERE q_id IN (SELECT q_id FROM x WHERE target = 1)
          AND (target = 1 OR {sql_hash(42, 'q_id', 'pid')} / 4294967296.0::DOUBLE < 0.05) ORDER BY q_id""",
)
def smp_negative_downsample(spark, sf):
    x = t(spark, sf, "orders").select(
        F.col("o_custkey").alias("q_id"), F.col("o_orderkey").alias("pid"), (F.col("o_orderpriority") == "1-URGENT").cast("int").alias("target")
    )
    return SP.negative_downsample(x, "q_id", "pid", "target").orderBy("q_id", "pid")


# ---- metrics -------------------------------------------------------------------------------------

SCORES = """sc AS (SELECT d.doc_id, d.source, l.quality, CAST(d.n_chars AS DOUBLE) / (d.n_chars + 1500) AS pred FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""


def doc_scores(spark, sf):
    d = t(spark, sf, "documents").select("doc_id", "source", (F.col("n_chars") / (F.col("n_chars") + 1500)).alias("pred"))
    return d.join(t(spark, sf, "labels").select("doc_id", "quality"), "doc_id")


def _auc_sql(group: str, by: str) -> str:
    return f"""rk AS (SELECT *, rank() OVER ({by} ORDER BY pred) + (count(*) OVER ({'PARTITION BY ' + group + ', pred' if group else 'PARTITION BY pred'}) - 1) / 2.0 AS r FROM sc),
ga AS (SELECT {group + ',' if group else ''} sum(quality) AS p, count(*) - sum(quality) AS q, sum(CASE WHEN quality = 1 THEN r ELSE 0 END) AS s FROM rk {'GROUP BY ' + group if group else ''})"""


@query("evl_auc", f"WITH {SCORES}, {_auc_sql('', '')} SELECT CAST(p AS BIGINT) AS positives, CAST(q AS BIGINT) AS negatives, {r6('(s - p * (p + 1) / 2.0) / (p * q)')} AS auc FROM ga")
def evl_auc(spark, sf):
    return M.auc(doc_scores(spark, sf), "quality", "pred").withColumn("auc", A.r6("auc"))


@query(
    "evl_weighted_auc",
    f"""WITH {SCORES}, {_auc_sql('source', 'PARTITION BY source')}, a AS (SELECT q, (s - p * (p + 1) / 2.0) / nullif(p * q, 0) AS auc FROM ga)
        SELECT {r6('sum(coalesce(auc, 0) * q) / sum(q)')} AS weighted_auc, CAST(sum(CASE WHEN auc IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS undefined_groups FROM a""",
)
def evl_weighted_auc(spark, sf):
    return M.weighted_auc(doc_scores(spark, sf), "source", "quality", "pred").withColumn("weighted_auc", A.r6("weighted_auc"))


@query(
    "evl_precision_recall",
    f"""WITH {SCORES}, x AS (SELECT CAST(pred >= 0.5 AS INTEGER) AS s, quality FROM sc)
        SELECT {r6('sum(s * quality) * 1.0 / sum(s)')} AS precision, {r6('sum(s * quality) * 1.0 / sum(quality)')} AS recall FROM x""",
)
def evl_precision_recall(spark, sf):
    p = M.precision_recall(doc_scores(spark, sf), "quality", "pred")
    return p.select(A.r6("precision").alias("precision"), A.r6("recall").alias("recall"))


@query("agg_confusion", f"WITH {SCORES} SELECT quality AS label, CAST(pred >= 0.5 AS INTEGER) AS pred, count(*) AS n FROM sc GROUP BY ALL")
def agg_confusion(spark, sf):
    return M.confusion(doc_scores(spark, sf), "quality", "pred")


@query(
    "agg_group_error_rate",
    f"""WITH {SCORES}, x AS (SELECT source, doc_id, quality, CAST(pred >= 0.5 AS INTEGER) AS pred FROM sc)
        SELECT source, doc_id, quality, pred, {r6('avg(CASE WHEN pred <> quality THEN 100.0 ELSE 0 END) OVER (PARTITION BY source)')} AS error FROM x""",
)
def agg_group_error_rate(spark, sf):
    return M.group_error_rate(doc_scores(spark, sf), "source", "doc_id", "quality", "pred").withColumn("error", A.r6("error"))


@query(
    "evl_retrieval",
    f"""WITH emb AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
        s AS (SELECT a.vec_id, CAST(a.label = b.label AS INTEGER) AS hit, row_number() OVER (PARTITION BY a.vec_id
                 ORDER BY {r6('list_cosine_similarity(a.v, b.v)')} DESC, b.vec_id) AS rank FROM emb a JOIN emb b ON a.vec_id <> b.vec_id),
        tp AS (SELECT *, sum(hit) OVER (PARTITION BY vec_id ORDER BY rank) * 1.0 / rank AS prec FROM s WHERE rank <= 10),
        q AS (SELECT vec_id, sum(hit) AS hits, sum(prec * hit) AS ap FROM tp GROUP BY vec_id),
        n AS (SELECT vec_id, count(*) OVER (PARTITION BY label) - 1 AS n FROM emb)
        SELECT {r6('avg(hits * 1.0::DOUBLE / n)')} AS recall, {r6('avg(CASE WHEN hits > 0 THEN 1.0 ELSE 0 END)')} AS hit_rate,
               {r6('avg(ap / least(n, 10))')} AS map, count(*) AS queries FROM q JOIN n ON q.vec_id = n.vec_id WHERE n > 0""",
)
def evl_retrieval(spark, sf):
    e = t(spark, sf, "embeddings")
    labels = e.select("vec_id", "label")
    top = N.knn_cosine(e, e, "vec_id", "vec_id", "embedding", "embedding", 10, skip_same=True)
    other = labels.select(F.col("vec_id").alias("item"), F.col("label").alias("_l"))
    judged = top.join(labels, "vec_id").join(other, "item").withColumn("hit", F.col("label") == F.col("_l"))
    sizes = G.with_group_stats(labels, "label", "vec_id", []).select("vec_id", (F.col("_n") - 1).alias("n_relevant"))
    m = M.retrieval(judged, "vec_id", "hit", "rank", sizes, 10)
    return m.select(*[A.r6(c).alias(c) for c in ("recall", "hit_rate", "map")], "queries")


# ---- ensembles -----------------------------------------------------------------------------------


@query("ens_mean_scores", f"WITH {SCORED} SELECT q_id, pid, {r6('(pred1 + pred2 + pred3) / 3')} AS pred FROM scored")
def ens_mean_scores(spark, sf):
    s = scored_pairs(spark, sf)
    return s.select("q_id", "pid", A.r6((F.col("pred1") + F.col("pred2") + F.col("pred3")) / 3).alias("pred"))


@query(
    "agg_mean_across_columns",
    f"""SELECT l_orderkey, l_linenumber,
               {r6("(l_discount + coalesce(CASE WHEN l_returnflag <> 'R' THEN l_tax END, 0) + coalesce(CASE WHEN l_linestatus <> 'F' THEN l_quantity END, 0)) / (1 + CAST(l_returnflag <> 'R' AS INTEGER) + CAST(l_linestatus <> 'F' AS INTEGER))")} AS mean
        FROM lineitem""",
)
def agg_mean_across_columns(spark, sf):
    cols = [F.col("l_discount"), F.when(F.col("l_returnflag") != "R", F.col("l_tax")), F.when(F.col("l_linestatus") != "F", F.col("l_quantity"))]
    return t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", A.r6(A.mean_of(*cols)).alias("mean"))


# Subsets of six models to compare; fixed values.
COMBINATIONS = {
    "lc": "lc", "lx": "lx", "xc": "xc", "lxc": "lxc", "lxcr": "lxcr", "lxcrt": "lxcrt", "lxcrtn": "lxcrtn", "xcrt": "xcrt", "xcrtn": "xcrtn",
}
_MODELS = "lcxrtn"
LONG = f"""long_ AS (SELECT o_custkey, o_orderkey, m AS model, f AS fold, {sql_hash('p', 'm', 'f', 'o_orderkey')} / 4294967296.0::DOUBLE AS pred
  FROM orders, (SELECT unnest({list(_MODELS)}) AS m), (SELECT unnest(range(2)) AS f))"""


def long_predictions(spark, sf):
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.lit(f).cast("long").alias("fold")) for m in _MODELS for f in range(2)]))
    o = t(spark, sf, "orders").select("o_custkey", "o_orderkey", each.alias("_e")).select("o_custkey", "o_orderkey", "_e.*")
    return o.withColumn("pred", portable_hash("p", "model", "fold", "o_orderkey") / F.lit(float(1 << 32)))


@query(
    "ens_blend_grid",
    f"""WITH {LONG}, combos(combination, model) AS (VALUES {", ".join(f"('{n}', '{m}')" for n, ms in COMBINATIONS.items() for m in ms)})
        SELECT combination, o_orderkey, {r6('avg(pred)')} AS pred FROM long_ JOIN combos ON long_.model = combos.model GROUP BY combination, o_orderkey""",
)
def ens_blend_grid(spark, sf):
    b = M.blend(long_predictions(spark, sf), ["o_orderkey"], "model", "pred", {n: list(ms) for n, ms in COMBINATIONS.items()})
    return b.withColumn("pred", A.r6("pred"))


@query(
    "ens_kfold_blend",
    f"WITH {LONG} SELECT o_custkey, o_orderkey, {r6('avg(pred)')} AS pred FROM long_ WHERE model <> 'x' GROUP BY o_custkey, o_orderkey",
)
def ens_kfold_blend(spark, sf):
    b = M.fold_blend(long_predictions(spark, sf), ["o_custkey", "o_orderkey"], "model", "pred", exclude=["x"])
    return b.withColumn("pred", A.r6("pred"))


@query(
    "set_oof_union",
    f"""SELECT o_custkey, o_orderkey, fold, {r6('pred')} AS pred FROM
        (SELECT o_custkey, o_orderkey, {sql_hash(42, 'o_custkey')} % 2 AS fold, {sql_hash('p', "'l'", sql_hash(42, 'o_custkey') + ' % 2', 'o_orderkey')} / 4294967296.0::DOUBLE AS pred FROM orders)""",
)
def set_oof_union(spark, sf):
    p = long_predictions(spark, sf).where("model = 'l'")
    return FE.out_of_fold(p, "o_custkey", "fold", k=2, seed=42).select("o_custkey", "o_orderkey", "fold", A.r6("pred").alias("pred"))


@query(
    "math_average_runs",
    f"""WITH {LONG}, a AS (SELECT o_orderkey, avg(pred) AS a FROM long_ WHERE model = 'l' GROUP BY o_orderkey),
        b AS (SELECT o_orderkey, avg(pred) AS b FROM long_ WHERE model = 'c' GROUP BY o_orderkey)
        SELECT a.o_orderkey, {r6('a')} AS mean_run, {r6('(a + b) / 2')} AS blended FROM a JOIN b ON a.o_orderkey = b.o_orderkey""",
)
def math_average_runs(spark, sf):
    p = long_predictions(spark, sf)
    a = M.average_runs(p.where("model = 'l'"), ["o_orderkey"], ["pred"]).withColumnRenamed("pred", "a")
    b = M.average_runs(p.where("model = 'c'"), ["o_orderkey"], ["pred"]).withColumnRenamed("pred", "b")
    return a.join(b, "o_orderkey").select(
        "o_orderkey", A.r6("a").alias("mean_run"), A.r6(FE.equal_blend(F.col("a"), F.col("b"))).alias("blended")
    )


_L = {"w2v_label_lof": "l_quantity > 25", "w2v_label_ilf": "l_discount > 0.05", "sci_label_lof": "l_tax > 0.04", "sci_label_dbs": "l_linenumber > 3"}
_P = {"w2v_pred_lof": "l_discount", "w2v_title_pred_lof": "l_tax", "sci_pred_km": "l_quantity"}


def _flag(e, column):
    # density flags are 0/1, the others -1/1
    return f"CASE WHEN {e} THEN 1 ELSE {0 if column.endswith('dbs') else -1} END"


@query(
    "feat_label_prefix_mean",
    "WITH x AS (SELECT l_orderkey, l_linenumber, " + ", ".join(f"CAST({e} AS INTEGER) AS {c}" for c, e in _L.items()) + ", l_discount AS p1, l_tax AS p2 FROM lineitem) "
    + f"""SELECT l_orderkey, l_linenumber, {r6('1 / (1 + exp(-(w2v_label_lof + w2v_label_ilf) / 2.0::DOUBLE))')} AS w2v_label_mean,
                {r6('1 / (1 + exp(-(sci_label_lof + sci_label_dbs) / 2.0::DOUBLE))')} AS sci_label_mean,
                {r6('1 / (1 + exp(-(w2v_label_lof + sci_label_lof) / 2.0::DOUBLE))')} AS lof_label_mean,
                {r6('1 / (1 + exp(-(p1 + p2) / 2))')} AS w2v_pred_mean_lof FROM x""",
)
def feat_label_prefix_mean(spark, sf):
    li = t(spark, sf, "lineitem")
    x = li.select(
        "l_orderkey", "l_linenumber", *[F.expr(_flag(e, c)).alias(c) for c, e in _L.items()], *[F.expr(e).alias(c) for c, e in _P.items()]
    )
    out = FE.prefix_means(x)
    cols = ["w2v_label_mean", "sci_label_mean", "lof_label_mean", "w2v_pred_mean_lof"]
    return out.select("l_orderkey", "l_linenumber", *[A.r6(c).alias(c) for c in cols])


# ---- models --------------------------------------------------------------------------------------

COLS = ["chars", "words", "mean_word", "lines", "distinct_share", "french"]


def doc_features(spark, sf):
    w = X.words("text")
    d = spread(t(spark, sf, "documents")).select(
        "doc_id",
        "source",
        F.col("n_chars").cast("double").alias("chars"),
        F.size(w).cast("double").alias("words"),
        (F.length("text") / F.greatest(F.size(w), F.lit(1))).alias("mean_word"),
        F.size(F.split("text", "\n")).cast("double").alias("lines"),
        (F.size(F.array_distinct(w)) / F.greatest(F.size(w), F.lit(1))).alias("distinct_share"),
        (F.col("lang") == "fr").cast("double").alias("french"),
    )
    labels = t(spark, sf, "labels").select("doc_id", F.col("quality").cast("double").alias("label"))
    return FE.pinned(d.join(labels, "doc_id", "left"))


def _fit_predict(spark, sf, pipeline):
    d = doc_features(spark, sf)
    model = pipeline.fit(SP.group_shuffle(d.where("label IS NOT NULL"), "source").where("is_test = 0"))
    return model, MD.predict(model, d.drop("label")).select("source", "doc_id", A.r6("pred").alias("pred"))


@query("mdl_gbt")
def mdl_gbt(spark, sf):
    d = doc_features(spark, sf)
    train = SP.group_shuffle(d.where("label IS NOT NULL"), "source").where("is_test = 0")
    train = SP.stratified_split(train, "label", "doc_id").withColumn("valid", F.col("is_valid") == 1)
    model = MD.gbt(COLS, rounds=10, validation="valid").fit(train)
    return MD.predict(model, d.drop("label")).select("source", "doc_id", A.r6("pred").alias("pred"))


@query("mdl_random_forest")
def mdl_random_forest(spark, sf):
    return _fit_predict(spark, sf, MD.random_forest(COLS))[1]


@query("agg_importance")
def agg_importance(spark, sf):
    model, _ = _fit_predict(spark, sf, MD.random_forest(COLS, trees=30))
    return MD.importance(model, COLS)


@query("mdl_mlp_pca")
def mdl_mlp_pca(spark, sf):
    return _fit_predict(spark, sf, MD.mlp_pca(COLS))[1]


@query("mdl_pair_scorer")
def mdl_pair_scorer(spark, sf):
    e = t(spark, sf, "embeddings")
    top = N.knn_cosine(e, e, "vec_id", "vec_id", "embedding", "embedding", 20, skip_same=True)
    labels = e.select("vec_id", "label")
    other = labels.select(F.col("vec_id").alias("item"), F.col("label").alias("_l"))
    pairs = top.join(labels, "vec_id").join(other, "item").select(
        "vec_id", "item", "score", F.col("rank").cast("double").alias("position"), (F.col("label") == F.col("_l")).cast("double").alias("target")
    )
    pairs = FE.pinned(pairs)
    model = MD.pair_scorer(["score", "position"]).fit(pairs)
    return MD.predict(model, pairs).select("vec_id", "item", "target", A.r6("pred").alias("pred"))


@query("udf_batch_infer")
def udf_batch_infer(spark, sf):
    v = MD.batch_infer(t(spark, sf, "documents"), "doc_id", "text", MD.hashing_encoder(64))
    return v.select("doc_id", F.size("vector").alias("dims"), A.r6(A.norm("vector")).alias("length"))


@query(
    "feat_basic",
    f"""WITH facts AS (SELECT o_custkey, o_orderkey, year(o_orderdate) AS year, count(l_linenumber) AS lines FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2, 3)
        SELECT o_custkey, o_orderkey, {r6('(year - avg(year) OVER w) / CASE WHEN stddev_pop(year) OVER w = 0 THEN 1 ELSE stddev_pop(year) OVER w END')} AS year,
               {r6('(lines - avg(lines) OVER w) / CASE WHEN stddev_pop(lines) OVER w = 0 THEN 1 ELSE stddev_pop(lines) OVER w END')} AS lines
        FROM facts WINDOW w AS (PARTITION BY o_custkey)""",
)
def feat_basic(spark, sf):
    f = order_facts(spark, sf).select("o_custkey", "o_orderkey", "year", "lines")
    z = G.standardize(f, "o_custkey", "o_orderkey", ["year", "lines"])
    return z.select("o_custkey", "o_orderkey", A.r6("year").alias("year"), A.r6("lines").alias("lines"))
