"""The split plans for large groups must give what the plain plans give; plans must keep their shape."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

import __spark_entry__ as entry_points
from peerlens.functions.hashing import portable_hash
from peerlens.operators import grouped as G
from peerlens.operators import metrics as M
from peerlens.operators import neighbours as N
from peerlens.operators import outliers as O
from peerlens.operators import sets as S
from peerlens.operators import tfidf as TF
from peerlens.operators import tiles as TL
from peerlens.operators import vectors as V
from peerlens.sources import sinks


@pytest.fixture(scope="module")
def emb(spark, folder):
    return spark.read.parquet(f"{folder}/embeddings.parquet").withColumnRenamed("label", "grp").cache()


@pytest.fixture(scope="module")
def hot(spark):
    """One group with a third of the rows, copies included."""
    rng = np.random.default_rng(0)
    rows = []
    for i in range(240):
        g = 0 if i < 80 else 1 + i % 16
        v = [1.0, 2.0, 3.0] if i < 30 else rng.normal(size=3).round(3).tolist()
        rows.append((g, i, v, float(i % 7)))
    return spark.createDataFrame(rows, "grp long, vec_id long, embedding array<double>, x double").cache()


def same(a, b, key="vec_id"):
    a, b = a.orderBy(key).collect(), b.select(*a.columns).orderBy(key).collect()
    assert len(a) == len(b)
    for r, s in zip(a, b):
        for x, y in zip(r, s):
            assert x == y if not isinstance(x, float) else x == pytest.approx(y, abs=1e-9)


@pytest.mark.parametrize("data", ["emb", "hot"])
@pytest.mark.parametrize(
    "op",
    [
        lambda d, n: V.pair_stats(d, "grp", "vec_id", "embedding", "c", tile_rows=n),
        lambda d, n: O.local_outlier_factor(d, "grp", "vec_id", "embedding", tile_rows=n),
        lambda d, n: O.density_flag(d, "grp", "vec_id", "embedding", eps=0.8, tile_rows=n),
        lambda d, n: O.oneclass_kernel(d, "grp", "vec_id", "embedding", tile_rows=n),
    ],
)
def test_tiles_do_not_change_results(request, data, op):
    d = request.getfixturevalue(data)
    same(op(d, 2048), op(d, 16))


def test_order_values_of_many_tiles(hot):
    tiles = TL.tiled(hot, "grp", "vec_id", tile_rows=16)
    state = TL.pair_moments(tiles, "grp", "vec_id", "embedding", measure="euclid", diagonal=None).where("_cnt > 3")
    got = TL.order_values(
        tiles, "grp", "vec_id", "embedding", state, {"third": F.lit(2), "last": F.col("_cnt") - 1},
        measure="euclid", diagonal=None, block_rows=7,
    ).collect()
    rows = hot.collect()
    for r in got:
        own = next(x for x in rows if x["vec_id"] == r["vec_id"])
        d = sorted(
            np.sqrt(((np.array(own["embedding"]) - np.array(x["embedding"])) ** 2).sum())
            for x in rows if x["grp"] == own["grp"] and x["vec_id"] != own["vec_id"]
        )
        assert r["third"] == pytest.approx(d[2], abs=1e-8) and r["last"] == pytest.approx(d[-1], abs=1e-8)


@pytest.mark.parametrize("values", ["close", "equal", "spread", "two"])
def test_order_values_however_concentrated(spark, values):
    rng = np.random.default_rng(1)
    v = np.ones((700, 6))
    if values != "equal":
        v = np.ones((700, 6)) + {"close": 1e-7, "spread": 1.0, "two": 0.0}[values] * rng.normal(size=(700, 6))
    v[0] = -v[0]  # one opposite vector spans the whole range
    if values == "two":
        v[350:, 0] = 2.0
    df = spark.createDataFrame([(0, i, x.tolist()) for i, x in enumerate(v)], "grp long, vec_id long, embedding array<double>").repartition(4)
    same(V.pair_stats(df, "grp", "vec_id", "embedding", "c"), V.pair_stats(df, "grp", "vec_id", "embedding", "c", tile_rows=300))


def test_selection_holds_a_fixed_number_of_values():
    rng = np.random.default_rng(2)
    x = 1 + 1e-9 * rng.random((4000, 1))
    x[0] = -1.0

    def rounds(rank, measured):
        pdf = {"g": 0, "k": [7], "_tile": [0], "_u": [0], "_side": [0], "v": [[0.0]], "_rank": [[rank]], "_lo": [[0.0]], "_hi": [[2.1]], "_left": [[4000]], "_found": [[None]]}
        for n in range(1, 12):
            unit = TL._Selection((0, 0), "k", "v", ["_rank", "_lo", "_hi", "_left", "_found"], "plain", "keep", 512)
            unit.add(pd.DataFrame(pdf))
            body = pd.DataFrame({"g": 0, "k": range(4000), "_tile": 1, "_u": 0, "_side": 1, "v": measured})
            unit.add(body)
            out = unit.result("g", "k")
            assert sum(len(i) for i, _ in unit.values[0]) <= TL._Selection.HELD
            if not out["_more"][0]:
                return n, out["_found"][0][0]
            pdf |= {c: out[c].tolist() for c in ("_rank", "_lo", "_hi", "_left", "_found")}
        raise AssertionError("no end")

    TL.MEASURES["plain"] = lambda a, b: np.abs(a - b.T)
    try:
        want = np.sort(np.abs(x[:, 0]))
        for rank in (0, 5, 1999, 3998, 3999):
            n, value = rounds(rank, [[float(r)] for r in x[:, 0]])
            assert value == want[rank] and n <= 4
        # Values whose gaps shrink like a power: the worst for equal parts of a range.
        y = 2.0 ** -np.arange(4000.0).clip(max=1000)
        n, value = rounds(1500, [[float(r)] for r in y])
        assert value == np.sort(y)[1500] and n <= 9
    finally:
        del TL.MEASURES["plain"]


def test_knn_tiles(emb):
    a = N.knn_cosine(emb, emb, "vec_id", "vec_id", "embedding", "embedding", 7, skip_same=True)
    b = N.knn_cosine(emb, emb, "vec_id", "vec_id", "embedding", "embedding", 7, skip_same=True, tile_rows=60, segment_rows=70)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    longer = N.knn_cosine(emb, emb, "vec_id", "vec_id", "embedding", "embedding", 8, skip_same=True)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, longer.where("rank <= 7").collect()))


def test_knn_copies_few_rows():
    """An item goes out once per query tile, so the tiles must be long where there are many rows."""
    def copies(n, k=10, width=64, tasks=48):
        tiles, segments = N.cuts(n, n, width, k, tasks)
        assert tiles * segments >= min(2 * tasks, n * n // 4096**2) and n / segments <= 131_072
        assert n / tiles <= max(2048, (1 << 22) / (width + 2 * k))
        return tiles + segments

    assert copies(600_000) <= 50 and copies(100_000) <= 21 and copies(10_000) <= 6
    assert N.cuts(0, 0, 1, 5, 4) == (1, 1) and copies(100_000, k=1000) <= 70 and copies(100_000, width=4096) <= 110


def test_knn_keeps_the_first_of_equal_scores(spark):
    """Copies, few items, a k above the items of a block and rising scores: all as in a plain sort."""
    vec = [[1.0, float(i % 7)] if i % 11 else [0.0, 0.0] for i in range(300)]
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vec)], "i int, v array<float>")
    x = np.array(vec)
    norm = np.sqrt((x * x).sum(1))
    for k, how in ((5, {}), (5, {"tile_rows": 90, "segment_rows": 40}), (400, {"min_score": 0.5})):
        got = sorted(tuple(r) for r in N.knn_cosine(df, df, "i", "i", "v", "v", k, skip_same=True, **how).collect())
        want = []
        for q in np.flatnonzero(norm):
            c = [(-round(float(x[q] @ x[o] / norm[q] / norm[o]) + 1e-10, 6), int(o)) for o in np.flatnonzero(norm) if o != q]
            best = [p for p in sorted(c) if -p[0] >= how.get("min_score", -2)][:k]
            want += [(int(q), o, -s, rank + 1) for rank, (s, o) in enumerate(best)]
        assert got == sorted(want)


def test_knn_blocks_without_any_vector(spark):
    df = spark.range(300).select(F.col("id").cast("int").alias("i"), F.when(F.col("id") >= 290, F.array(F.lit(1.0), F.col("id") * 1.0)).alias("v"))
    got = N.knn_cosine(df, df, "i", "i", "v", "v", 3, skip_same=True, tile_rows=5, segment_rows=5).collect()
    assert {r["i"] for r in got} == set(range(290, 300)) and len(got) == 30 and {r["item"] for r in got} <= set(range(290, 300))


def test_ranks_quantiles_and_indexes(hot):
    w = Window.partitionBy("grp").orderBy("x", "vec_id")
    plain = hot.select("grp", "vec_id", F.row_number().over(w).cast("long").alias("rank"))
    same(plain, G.group_ranks(hot, "grp", [F.col("x"), F.col("vec_id")], "vec_id", split_rows=10))
    q = {"a": 0.1, "b": 0.5, "c": 0.97}
    same(G.group_quantiles(hot, "grp", "x", "vec_id", q), G.group_quantiles(hot, "grp", "x", "vec_id", q, split_rows=10), "grp")
    hashed = hot.withColumn("h", portable_hash(1, "vec_id"))
    wh = Window.partitionBy("grp").orderBy("h", "vec_id")
    plain = hashed.select("grp", "vec_id", (F.row_number().over(wh) - 1).cast("long").alias("rank"))
    same(plain, G.hash_rank(hashed, "grp", "vec_id", "h", split_rows=10))
    # A key beyond the split size gets the same numbers, in item order.
    same(G.dense_index(hot, "grp", "vec_id"), G.dense_index(hot, "grp", "vec_id", split_rows=10))


def test_group_stats_split(hot):
    aggs = [F.avg("x").alias("m"), F.max("x").alias("hi")]
    same(G.with_group_stats(hot, "grp", "vec_id", aggs), G.with_group_stats(hot, "grp", "vec_id", aggs, split_rows=7))
    running = G.running_totals(hot.select("vec_id", "x"), [F.col("vec_id")], {"before": "x"}).orderBy("vec_id").collect()
    assert [r["before"] for r in running] == pytest.approx(np.concatenate([[0], np.cumsum([r["x"] for r in running])[:-1]]).tolist())


def test_average_ranks(hot):
    w = Window.partitionBy("grp")
    plain = hot.select(
        "grp", "vec_id", (F.rank().over(w.orderBy("x")) + (F.count("x").over(Window.partitionBy("grp", "x")) - 1) / 2).alias("r")
    )
    same(plain, G.average_ranks(hot, "grp", "x", "vec_id", "r"))


def test_set_scores_tiles_and_copies(spark):
    rng = np.random.default_rng(3)
    rows = [(i % 3 if i > 40 else 0, i, ["hot", "pair"] if i < 30 else [f"e{k}" for k in rng.integers(0, 12, rng.integers(0, 5))]) for i in range(120)]
    df = spark.createDataFrame(rows, "g long, vec_id long, e array<string>").cache()
    a = S.pair_scores(df, "g", "vec_id", "e", "s")
    same(a, S.pair_scores(df, "g", "vec_id", "e", "s", tile_rows=5))
    sets = {(r[0], r[1]): set(r[2]) for r in rows}
    for r in a.collect():
        own = sets[(r["g"], r["vec_id"])]
        peers = [s for (g, i), s in sets.items() if g == r["g"] and i != r["vec_id"]]
        jac = sum(len(own & s) / len(own | s) for s in peers if own and s)
        assert r["s_jac"] == pytest.approx(jac / (len(peers) + 1))
        assert r["s_co"] == pytest.approx(sum(bool(own & s) for s in peers) / (len(peers) + 1))


def test_tfidf_cosine_tiles(spark, folder):
    d = spark.read.parquet(f"{folder}/documents.parquet")
    w = TF.tfidf(d, "source", "doc_id", "text")
    a = TF.tfidf_cosine(w, "source", "doc_id")
    same(a, TF.tfidf_cosine(w, "source", "doc_id", tile_rows=3), "doc_id")
    linear = TF.cosine_mean(w, "source", "doc_id").select("source", "doc_id", "cos_mean")
    same(linear, a, "doc_id")


def test_json_parts(spark):
    df = spark.createDataFrame([(1, i, i / 2) for i in range(10)], "g long, i long, v double")
    assert sinks.group_json(df, "g", "i", "v").count() == 1
    assert sinks.implode_map(df, "g", "i", "v", max_items=4).count() == 3


def test_folds(spark, folder):
    from peerlens.operators import splits as SP

    o = spark.read.parquet(f"{folder}/orders.parquet")
    f = SP.group_kfold(o, "o_custkey", 4)
    assert f.count() == o.count()
    assert f.groupBy("o_custkey").agg(F.count_distinct("fold").alias("n")).where("n > 1").count() == 0
    s = SP.stratified_kfold(o, "o_orderstatus", "o_orderkey").groupBy("o_orderstatus", "fold").count().collect()
    for status in {r["o_orderstatus"] for r in s}:
        n = [r["count"] for r in s if r["o_orderstatus"] == status]
        assert max(n) - min(n) <= 1


@pytest.mark.parametrize("parts", [1, 30])
def test_partition_count_does_not_matter(spark, folder, parts):
    names = ["set_pair_scores", "out_lof", "evl_weighted_auc", "smp_stratified_kfold", "topk_knn"]
    q = entry_points.queries()
    want = {n: sorted(map(tuple, q[n](spark, folder).collect())) for n in names}
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        for n in names:
            assert sorted(map(tuple, q[n](spark, folder).collect())) == want[n]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans(spark, folder):
    q = entry_points.queries()
    for n in ["topk_final", "topk_candidates", "topk_knn"]:
        assert "WindowGroupLimit" in plan(q[n](spark, folder)), n
    for n in ["set_pair_scores", "agg_pair_stats", "tfi_cosine", "topk_knn", "gra_metapath_walk", "join_self_pairs"]:
        p = plan(q[n](spark, folder))
        assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p, n
    for n in ["txt_clean", "agg_row_stats", "win_standardize", "ens_mean_scores", "smp_group_kfold"]:
        p = plan(q[n](spark, folder))
        assert "Python" not in p and "InPandas" not in p, n
    p = plan(q["src_parquet"](spark, folder))
    assert "GreaterThan(n_chars,1000)" in p and "text" not in p.split("ReadSchema")[1].split("\n")[0]


# ---- fitted detectors against direct numpy versions ------------------------------------------------


def test_robust_distance_against_numpy(spark):
    rng = np.random.default_rng(5)
    x = np.vstack([rng.normal(size=(60, 2)) @ [[1, 0.4], [0, 1]], [[8, 8], [9, -7]]])
    df = spark.createDataFrame([(1, i, v.tolist()) for i, v in enumerate(x)], "g long, i long, v array<double>")
    got = np.array([r["dist2"] for r in O.mahalanobis_robust(df, "g", "i", "v", steps=3).orderBy("i").collect()])

    def dist(sub):
        m, c = sub.mean(0), np.cov(sub.T, bias=True)
        return np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m)

    d, h = dist(x), (len(x) + 3) // 2
    for _ in range(3):
        d = dist(x[np.argsort(d, kind="stable")[:h]])
    d *= O.chi2_quantile(0.5, 2) / np.median(d)
    want = dist(x[d < O.chi2_quantile(0.975, 2)])
    assert got == pytest.approx(want, rel=1e-6)
    assert set(np.argsort(got)[-2:]) == {60, 61}


def test_mixture_against_numpy(spark):
    rng = np.random.default_rng(6)
    x = np.vstack([rng.normal(size=(40, 2)), rng.normal(size=(30, 2)) * 0.5 + 5])
    df = spark.createDataFrame([(1, i, v.tolist()) for i, v in enumerate(x)], "g long, i long, v array<double>")
    got = [r["loglik"] for r in O.mixture_loglik(df, "g", "i", "v", rounds=4).orderBy("i").collect()]
    r = np.array([r["cluster"] for r in O.two_means(df, "g", "i", "v", rounds=3).orderBy("i").collect()], float)
    for step in range(5):
        logs = []
        for w in (1 - r, r):
            m = (w[:, None] * x).sum(0) / w.sum()
            c = (w[:, None] * x).T @ x / w.sum() - np.outer(m, m) + 1e-6 * np.eye(2)
            z = x - m
            logs.append(np.log(w.sum() / len(x)) - 0.5 * (np.einsum("ij,jk,ik->i", z, np.linalg.inv(c), z) + np.log(np.linalg.det(c)) + 2 * np.log(2 * np.pi)))
        ll = np.logaddexp(*logs)
        r = np.exp(logs[1] - ll)
    assert got == pytest.approx(ll.tolist(), rel=1e-6)


def test_forest_paths():
    rng = np.random.default_rng(7)
    x = np.vstack([rng.normal(size=(100, 3)), [[12.0, 12, 12]]])
    forest = O.grow_forest(x, 50, np.random.default_rng(1))
    feature, threshold, left, path = forest

    def walk(v, tree):
        n = tree
        while feature[n] >= 0:
            n = left[n] + int(v[feature[n]] > threshold[n])
        return path[n]

    want = [np.mean([walk(v, t) for t in range(50)]) for v in x]
    assert O.forest_path(x, forest, 50) == pytest.approx(want)
    assert np.argmin(want) == 100
    same_rows = O.grow_forest(np.ones((5, 2)), 3, np.random.default_rng(1))
    assert (same_rows[0] == -1).all() and len(same_rows[0]) == 3


def test_isolation_chunks(hot):
    a = O.isolation_forest(hot, "grp", "vec_id", "embedding", trees=20)
    same(a, O.isolation_forest(hot, "grp", "vec_id", "embedding", trees=20, chunk_rows=9))



def test_retrieval_blocks(spark, emb):
    d = emb.withColumn("fold", F.col("vec_id") % 3)
    out = N.knn_cosine(d, d, "vec_id", "vec_id", "embedding", "embedding", 5, not_within=("fold", "fold"))
    assert out.where(F.col("vec_id") % 3 == F.col("item") % 3).count() == 0 and out.count() == 2500


def test_error_rate_and_blend(spark):
    df = spark.createDataFrame([("a", 1, 1, 0.9), ("a", 2, 0, 0.8), ("b", 3, 1, 0.7)], "g string, i long, y int, p double")
    rows = M.group_error_rate(df, "g", "i", "y", "p").collect()
    assert [(r["g"], r["error"]) for r in rows] == [("a", 50.0), ("a", 50.0), ("b", 0.0)]
    long = spark.createDataFrame([("l", 1, 0.2), ("c", 1, 0.6), ("x", 1, 1.0)], "m string, i long, p double")
    got = {r["combination"]: r["pred"] for r in M.blend(long, ["i"], "m", "p", {"lc": ["l", "c"], "x": ["x"]}).collect()}
    assert got == pytest.approx({"lc": 0.4, "x": 1.0})


def test_knn_large_and_string_keys(spark):
    base = 9_007_199_254_740_993  # beyond exact doubles
    rows = [(base + i, f"p{i:02d}", [1.0, i / 10]) for i in range(6)]
    df = spark.createDataFrame(rows, "q long, p string, v array<double>")
    out = N.knn_cosine(df, df, "q", "p", "v", "v", 1).orderBy("q").collect()
    assert [(r["q"], r["item"]) for r in out] == [(q, p) for q, p, _ in rows]
