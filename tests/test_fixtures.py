"""Small literal inputs with results worked out by hand."""

import math

import pytest
from pyspark.sql import functions as F

from peerlens.functions import arrays as A
from peerlens.functions import language as L
from peerlens.functions import text as X
from peerlens.functions.stem import stem
from peerlens.operators import features as FE
from peerlens.operators import graph as GR
from peerlens.operators import grouped as G
from peerlens.operators import metrics as M
from peerlens.operators import neighbours as N
from peerlens.operators import outliers as O
from peerlens.operators import rows as W
from peerlens.operators import sets as S
from peerlens.operators import splits as SP
from peerlens.operators import vectors as V
from peerlens.sources import readers as RD
from peerlens.sources import sinks as SI


def one(spark, value, fn):
    return spark.createDataFrame([(value,)], "c string").select(fn("c")).first()[0]


def test_shorten(spark):
    assert one(spark, "a b c d e f g", lambda c: X.shorten(c, 4)) == "a b...f g"
    assert one(spark, "a b c d e f g", lambda c: X.shorten(c, 7)) == "a b c d e f g"


@pytest.mark.parametrize(
    "name,want",
    [("Wei Zhang", "weizhang"), ("Zhang Wei", "weizhang"), ("John Ronald Reuel Tolkien", "johnronaldreuel"), ("7", "NULL"), ("", "NULL")],
)
def test_canonical_name(spark, name, want):
    assert one(spark, name, lambda c: X.canonical_name(X.clean(c))) == want


def test_tokens(spark):
    stop = X.STOP_WORDS
    assert one(spark, "The 3 new cells in 2020s", lambda c: X.tokens(X.clean(c), stop)) == ["new", "cells", "0s"]
    assert one(spark, None, lambda c: X.clean(c)) == ""
    assert one(spark, "null", lambda c: X.tokens(c, stop)) == []
    assert one(spark, "['a1', 'b2']", X.parse_list) == ["a1", "b2"]


def test_clean_keeps_accents(spark):
    assert one(spark, "  Été—(été)\n x ", X.clean) == "été été x"
    assert one(spark, "日本 nature", X.has_cjk) is True
    assert one(spark, "日本 nature 語", X.cjk_runs) == ["日本", "語"]
    assert one(spark, "see [x](y) and <b>y</b> (z) at https://a.b/c?d=1 end", X.remove_links).split() == ["see", "and", "y", "at", "end"]
    # the link pattern takes a closing bracket with it, so the rest up to the next one goes as well
    assert one(spark, "see [x](http://a.b/c) and (z)", X.remove_links).split() == ["see"]


def test_year(spark):
    rows = spark.createDataFrame([("0",), ("",), (None,), ("1999",), ("x",)], "c string").select(X.clean_year("c")).collect()
    assert [r[0] for r in rows] == [None, None, None, 1999, None]


@pytest.mark.parametrize(
    "word,want",
    [("caresses", "caress"), ("ponies", "poni"), ("agreed", "agre"), ("motoring", "motor"), ("hopping", "hop"), ("filing", "file"),
     ("happy", "happi"), ("relational", "relat"), ("hopefulness", "hope"), ("adoption", "adopt"), ("controlling", "control")],
)
def test_stem(word, want):
    assert stem(word) == want


def test_jaccard_and_pair_scores(spark):
    df = spark.createDataFrame([(1, 1, ["a", "b"]), (1, 2, ["b", "c"]), (1, 3, [])], "g int, i int, e array<string>")
    rows = S.pair_scores(df, "g", "i", "e", "x").orderBy("i").collect()
    assert [r["x_co"] for r in rows] == pytest.approx([1 / 3, 1 / 3, 0])
    assert [r["x_jac"] for r in rows] == pytest.approx([1 / 9, 1 / 9, 0])
    j = spark.createDataFrame([(["a", "b"], ["b", "c"])], "a array<string>, b array<string>").select(A.jaccard("a", "b")).first()[0]
    assert j == pytest.approx(1 / 3)


VECTORS = [(1, 1, [1.0, 0.0]), (1, 2, [0.0, 1.0]), (1, 3, [1.0, 0.0])]


def test_pair_stats(spark):
    df = spark.createDataFrame(VECTORS, "g int, i int, v array<double>")
    r = V.pair_stats(df, "g", "i", "v", "c").where("i = 1").first()
    assert (r["c_mean"], r["c_median"], r["c_q75"]) == pytest.approx((1 / 3, 0, 0.5))
    assert r["c_std"] == pytest.approx(0.577350, abs=1e-6)
    assert V.cos_mean_linear(df, "g", "i", "v", "m").where("i = 1").first()["m"] == pytest.approx(1 / 3)


def test_zero_vector(spark):
    df = spark.createDataFrame(VECTORS + [(1, 4, [0.0, 0.0])], "g int, i int, v array<double>")
    stats = {r["i"]: r["c_mean"] for r in V.pair_stats(df, "g", "i", "v", "c").collect()}
    linear = {r["i"]: r["m"] for r in V.cos_mean_linear(df, "g", "i", "v", "m").collect()}
    assert stats[1] == pytest.approx(1 / 3) and stats[4] == 0  # own zero only
    assert linear == pytest.approx(stats)


def test_density(spark):
    df = spark.createDataFrame([(1, i, [1.0, 0.0]) for i in range(4)] + [(1, 9, [0.0, 1.0])], "g int, i int, v array<double>")
    for size in (2048, 2):
        assert [r["dense"] for r in O.density_flag(df, "g", "i", "v", tile_rows=size).orderBy("i").collect()] == [1, 1, 1, 1, 0]


def test_lof_alone_and_copies(spark):
    df = spark.createDataFrame([(1, 1, [1.0])] + [(2, i, [1.0]) for i in range(5)], "g int, i int, v array<double>")
    rows = O.local_outlier_factor(df, "g", "i", "v").orderBy("g", "i").collect()
    assert (rows[0]["factor"], rows[0]["score"], rows[0]["label"]) == (None, None, 1)
    assert all(r["factor"] == pytest.approx(-1) and r["label"] == 1 for r in rows[1:])


def test_weighted_auc(spark):
    rows = [("A", 1, 0.9), ("A", 0, 0.1), ("B", 1, 0.5), ("B", 0, 0.5), ("B", 0, 0.2)]
    df = spark.createDataFrame(rows, "g string, y int, p double")
    assert M.weighted_auc(df, "g", "y", "p").first()["weighted_auc"] == pytest.approx(0.833333, abs=1e-6)
    more = df.union(spark.createDataFrame([("C", 1, 0.3), ("C", 1, 0.4)], df.schema))
    r = M.weighted_auc(more, "g", "y", "p").first()
    assert r["weighted_auc"] == pytest.approx(0.833333, abs=1e-6) and r["undefined_groups"] == 1


def test_auc_of_negated_score(spark, folder):
    d = spark.read.parquet(f"{folder}/documents.parquet").join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id")
    a = M.auc(d, "quality", "n_chars").first()["auc"]
    b = M.auc(d.withColumn("n", -F.col("n_chars")), "quality", "n").first()["auc"]
    assert a + b == pytest.approx(1)


def test_prefix_mean(spark):
    df = spark.createDataFrame([(1, -1, 1, 1)], "w2v_label_lof int, w2v_label_ilf int, w2v_label_ocs int, w2v_x_label_dbs int")
    assert FE.prefix_means(df).first()["w2v_label_mean"] == pytest.approx(0.679179, abs=1e-6)
    other = spark.createDataFrame([(1, 0)], "graph_w2v_label_lof int, w2v_label_lof int")
    assert FE.prefix_means(other).first()["w2v_label_mean"] == pytest.approx(0.5)  # whole name parts only


def test_scores_left_and_keep_first(spark):
    a = spark.createDataFrame([("q", "p", 0.9)], "q string, p string, pred1 double")
    b = spark.createDataFrame([], "q string, p string, pred2 double")
    c = spark.createDataFrame([("q", "p", 0.3)], "q string, p string, pred3 double")
    r = W.scores_left(a, [b, c], ["q", "p"], ["pred1", "pred2", "pred3"]).first()
    assert (r["pred1"] + r["pred2"] + r["pred3"]) / 3 == pytest.approx(0.4)
    d = spark.createDataFrame([("q1", "p1", 2), ("q1", "p1", 1)], "q string, p string, r int")
    assert [r["r"] for r in W.keep_first(d, ["q", "p"], [F.col("r")]).collect()] == [1]


def test_downsample(spark):
    rows = [(1, 0, 1)] + [(1, i, 0) for i in range(1, 21)] + [(2, i, 0) for i in range(5)]
    out = SP.negative_downsample(spark.createDataFrame(rows, "q int, i int, y int"), "q", "i", "y").collect()
    assert {r["q"] for r in out} == {1} and sum(r["y"] for r in out) == 1


def test_standardize_constant(spark):
    df = spark.createDataFrame([(1, i, 5.0) for i in range(3)], "g int, i int, x double")
    assert [r["x"] for r in G.standardize(df, "g", "i", ["x"]).collect()] == [0, 0, 0]


def test_walks(spark):
    edges = spark.createDataFrame([(1, "a", "p1"), (1, "a", "p2")], "g int, key string, p string")
    papers = spark.createDataFrame([(1, "p1"), (1, "p2"), (1, "p3")], "g int, p string")
    hops = [GR.hop_table(edges, "g", "p"), GR.hop_table(edges.limit(0), "g", "p")]
    rows = GR.metapath_walks(papers, hops, "g", "p", walks=2, steps=3).collect()
    paths = {(r["p"], r["walk"]): r["path"] for r in rows}
    assert paths[("p1", 0)] == paths[("p1", 1)] == ["p2", "p1", "p2"] and paths[("p3", 0)] == []
    none = GR.metapath_walks(papers, [GR.hop_table(edges.limit(0), "g", "p")], "g", "p", walks=1, steps=1).collect()
    assert sorted(r["path"] for r in none) == [["p1"], ["p2"], ["p3"]]


def test_chi2():
    assert O.chi2_quantile(0.5, 2) == pytest.approx(2 * math.log(2))
    assert O.chi2_quantile(0.975, 2) == pytest.approx(-2 * math.log(0.025))


def test_clean_papers(spark):
    from peerlens.plans import papers as PP
    from peerlens.sources.readers import papers_schema

    raw = spark.createDataFrame(
        [
            ("p1", "The New Cells in 2020s", None, ["Graph Theory", "cells"], [("Wei Zhang", "Lab of Networks, Univ 12"), ("", "")], "Nature", "0"),
            ("p2", "", "null", [], [("John Ronald Reuel Tolkien", "Oxford")], None, "1999"),
        ],
        papers_schema(),
    )
    rows = {r["id"]: r for r in PP.clean_papers(raw).collect()}
    assert rows["p1"]["title"] == ["new", "cell", "0s"] and rows["p1"]["keywords"] == ["graph", "theori", "cell"]
    assert [tuple(a) for a in rows["p1"]["authors"]] == [("weizhang", "network"), ("NULL", "NULL")]
    assert rows["p1"]["num_authors"] == 2 and rows["p1"]["year"] is None and rows["p1"]["a_lang"] == "Nothing"
    assert rows["p1"]["t_lang"] == "en" and rows["p1"]["names"] == ["NULL", "weizhang"]
    assert rows["p2"]["abstract"] == [] and rows["p2"]["year"] == 1999 and rows["p2"]["names"] == ["johnronaldreuel"]
    light = {r["id"]: r for r in PP.clean_papers_light(raw).collect()}
    assert light["p1"]["title"] == "the new cells in 0s" and light["p1"]["keywords"] == "graph theory,cells"
    assert light["p1"]["authors"][0]["name"] == "wei zhang"
    corpus = {r["id"]: r["tokens"] for r in PP.paper_corpus(PP.clean_papers(raw)).collect()}
    assert corpus == {"p1": ["new", "cell", "0s", "graph", "theori", "cell", "natur"]}


def test_members(spark):
    from peerlens.plans import papers as PP

    g = spark.createDataFrame([("a", "Wei Zhang", ["p1", "p2"], []), ("b", "X", [], ["p3"])], "id string, name string, normal_data array<string>, outliers array<string>")
    got = sorted((r["author_id"], r["name"], r["paper_id"], r["label"]) for r in PP.members(g).collect())
    assert got == [("a", "weizhang", "p1", 1), ("a", "weizhang", "p2", 1), ("b", "x", "p3", 0)]


# ---- rows that must not be lost ---------------------------------------------------------------------


def test_null_vectors_have_no_partner(spark):
    rows = [("a", 1, [1.0, 0.0]), ("a", 2, [0.0, 1.0]), ("a", 3, None), ("a", 4, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "g string, i int, v array<double>")
    for tile_rows in (2048, 2):
        got = {r["i"]: r for r in V.pair_stats(df, "g", "i", "v", "c", tile_rows=tile_rows).collect()}
        assert got[3]["c_max"] == 0.0 and got[1]["c_max"] == pytest.approx(0.5**0.5)
    factors = {r["i"]: r["factor"] for r in O.local_outlier_factor(df, "g", "i", "v").collect()}
    assert len(factors) == 4 and factors[3] is None
    near = N.knn_cosine(df, df, "i", "i", "v", "v", 2, skip_same=True).collect()
    assert 3 not in {r["i"] for r in near} | {r["item"] for r in near}
    fitted = {r["i"]: r["loglik"] for r in O.mixture_loglik(df, "g", "i", "v", rounds=2).collect()}
    assert len(fitted) == 4 and fitted[3] is None


def test_null_values_and_labels_keep_their_rows(spark):
    df = spark.createDataFrame([("a", 1, 2.0), ("a", 2, None), ("a", 3, 2.0), ("a", 4, 1.0)], "g string, i int, x double")
    assert {r["i"]: r["r"] for r in G.average_ranks(df, "g", "x", "i", "r").collect()} == {1: 2.5, 2: None, 3: 2.5, 4: 1.0}
    assert SP.stratified_kfold(df, "x", "i", 2).count() == 4 and SP.stratified_split(df, "x", "i", 0.5).count() == 4


def test_language_by_script(spark):
    texts = ["ひらがな", "カタカナと日本", "日本 的", "the cat is in", "der und die", "", None, "xyz"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r["i"]: r["language"] for r in L.detect(df, "i", "t").collect()}
    assert [got[i] for i in range(8)] == ["ja", "ja", "zh", "en", "de", "Nothing", "Nothing", "Other"]


def test_single_json_object_file(spark, tmp_path):
    path = tmp_path / "papers.json"
    path.write_text('{\n "p1": {"title": "A",\n "abstract": null},\n "p2": {"title": "B"}\n}')
    got = RD.read_json_map(spark, str(path), one_object_per_file=True).orderBy("pid").collect()
    assert [tuple(r) for r in got] == [("p1", "A", None), ("p2", "B", None)]


def test_repeated_items_keep_the_largest_value(spark):
    df = spark.createDataFrame([("g", "a", 1.0), ("g", "a", 3.0), ("g", "b", 2.0)], "g string, i string, v double")
    assert [r["map"] for r in SI.implode_map(df, "g", "i", "v").collect()] == [{"a": 3.0, "b": 2.0}]


def test_repeated_feature_keys_are_refused(spark):
    ids = spark.createDataFrame([(1,), (2,)], "k int")
    once = spark.createDataFrame([(1, "a", 1.0)], "k int, s string, v double")
    assert W.wide_features(ids, [once], ["k"]).count() == 2
    with pytest.raises(Exception, match="repeated key"):
        W.wide_features(ids, [once.unionByName(once)], ["k"]).collect()
