"""Walk moves, co-occurrence and the factors of its information against plain versions."""

from collections import Counter, defaultdict

import numpy as np
import pytest

import __spark_entry__ as entry_points
from peerlens import runtime
from peerlens.catalog import peers
from peerlens.operators import graph as GR
from peerlens.plans import graph as GP


@pytest.fixture(scope="module")
def graph(spark):
    """Two groups of papers with shared keys, one of them with two sides that meet in one paper; and a group without edges."""
    rows = [("g", p, f"k{p % 3}") for p in range(8)] + [("g", p, "left" if p < 4 else "right") for p in range(8)] + [("g", 4, "left")]
    rows += [("h", 100 + p, f"k{p // 2}") for p in range(6)]
    edges = spark.createDataFrame(rows, "grp string, paper long, key string")
    papers = spark.createDataFrame([("g", p) for p in range(8)] + [("h", 100 + p) for p in range(6)] + [("i", 200)], "grp string, paper long")
    return papers, [GR.hop_table(edges, "grp", "paper")], rows


def test_moves_follow_shared_keys(graph):
    papers, hops, rows = graph
    keys = defaultdict(set)
    for g, p, k in rows:
        keys[g, p].add(k)
    moves = GR.walk_steps(papers, hops, "grp", "paper", walks=2, steps=3, runs=2).collect()
    at = {}
    for m in sorted(moves, key=lambda m: m["step"]):
        walk = (m["grp"], m["paper"], m["run"], m["walk"])
        here = at.get(walk, m["paper"])
        assert m["next"] != here and keys[m["grp"], here] & keys[m["grp"], m["next"]]
        at[walk] = m["next"]
    assert {m["run"] for m in moves} == {0, 1} and not any(m["grp"] == "i" for m in moves)


def test_vectors_are_factors_of_the_information(graph):
    papers, hops, _ = graph
    how = dict(walks=8, steps=4, runs=2)
    moves = GR.walk_steps(papers, hops, "grp", "paper", **how).collect()
    walks = defaultdict(list)
    for m in sorted(moves, key=lambda m: m["step"]):
        walks[m["grp"], m["run"], m["paper"], m["walk"]].append(m["next"])
    pairs = defaultdict(Counter)
    for (g, r, _, _), w in walks.items():
        for i, a in enumerate(w):
            for j, b in enumerate(w):
                if i != j and abs(i - j) <= 4:
                    pairs[g, r][a, b] += 1
    vectors = {(v["grp"], v["run"], v["paper"]): np.array(v["vector"]) for v in GP.walk_vectors(papers, hops, "grp", "paper", size=9, window=4, **how).collect()}
    assert len(vectors) == 2 * 15
    for (g, r), counts in pairs.items():
        names = sorted({a for a, _ in counts})
        m = np.zeros((len(names), len(names)))
        total = sum(counts.values())
        one = Counter()
        for (a, _), n in counts.items():
            one[a] += n
        for (a, b), n in counts.items():
            m[names.index(a), names.index(b)] = max(0.0, np.log(n * total / (one[a] * one[b])))
        u, s, _ = np.linalg.svd(m)
        want = (u * np.sqrt(s))[:, :9]
        got = np.array([vectors[g, r, p] for p in names])
        assert got @ got.T == pytest.approx(want @ want.T, abs=1e-6)
    assert all((vectors["i", r, 200] == 0).all() for r in (0, 1))


def test_edges_take_more_tasks_for_more_rows(spark, folder, monkeypatch):
    """What a task holds must not grow with the tables, and the rows stay the same."""
    names = ("gra_edges", "gra_adjacency")
    plain = {n: sorted(map(tuple, entry_points.queries()[n](spark, folder).collect())) for n in names}
    monkeypatch.setattr(runtime, "TASK_ROWS", 500)
    lines = spark.read.parquet(f"{folder}/lineitem.parquet").count()
    edges = peers.graph_edges(spark, folder)["author"]
    assert edges.rdd.getNumPartitions() == -(-lines // 500) > int(spark.conf.get("spark.sql.shuffle.partitions"))
    for n in names:
        assert sorted(map(tuple, entry_points.queries()[n](spark, folder).collect())) == plain[n]


def test_one_task_walks_like_joins(spark, monkeypatch):
    """Groups in one task, a few at a time, and by joins: the same moves, paths and vectors, also of papers that come twice or are NULL."""
    rows = [("g", p, f"k{p % 3}") for p in range(8)] + [("g", p, "left" if p < 4 else "right") for p in range(8)] + [("g", None, "left"), ("g", 50, "k1")]
    rows += [(f"h{i}", 100 * i + p, f"k{p // 2}") for i in range(4) for p in range(6)]
    papers = [("g", p) for p in (*range(8), 3, None)] + [(f"h{i}", 100 * i + p) for i in range(4) for p in range(6)] + [("i", 900), ("i", 900), ("i", 901), (None, 950)]
    edges = spark.createDataFrame(rows, "grp string, paper long, key string")
    papers = spark.createDataFrame(papers, "grp string, paper long")
    hops = [GR.hop_table(edges.where("key not in ('left', 'right')"), "grp", "paper"), GR.hop_table(edges.where("key in ('left', 'right')"), "grp", "paper")]

    def answers():
        moves = sorted(map(repr, GR.walk_steps(papers, hops, "grp", "paper", walks=2, steps=3, runs=2, seed=1).collect()))
        paths = sorted(map(repr, GR.metapath_walks(papers, hops, "grp", "paper", walks=2, steps=3).collect()))
        vectors = GP.walk_vectors(papers, hops, "grp", "paper", walks=3, steps=4, runs=2, size=9, window=3).collect()
        return moves, paths, sorted((str(v["grp"]), str(v["paper"]), v["run"], round(float(np.linalg.norm(v["vector"])), 6), len(v["vector"])) for v in vectors)

    one = answers()
    monkeypatch.setattr(GR, "TOGETHER", 20)
    assert answers() == one
    monkeypatch.setattr(GR, "GROUP_PAPERS", 0)
    assert answers() == one


def test_groups_of_one_task_write_no_hops(spark, graph, monkeypatch):
    """A hop of small groups is no written table."""
    papers, hops, _ = graph
    written = []
    monkeypatch.setattr(GR, "pin", lambda df, name="pin": written.append(name) or runtime.pin(df, name))
    assert GR.metapath_walks(papers, hops, "grp", "paper", walks=1, steps=3).count() == 15
    assert written == ["large-groups"]


def test_draws_are_the_engine_s(spark):
    from pyspark.sql import functions as F

    from peerlens.functions import hashing as H

    heads, tails = [b"0", b"12"], [f"{x}|{w}".encode() for x in (1, 22, 333333, "ä" * 30) for w in range(3)]
    which = [(h, t) for h in range(2) for t in range(len(tails))]
    draws = H.TextDraws(heads, tails, *(np.array(x) for x in zip(*which)))
    rows = [(i, heads[draws.head[i]].decode(), *tails[draws.tail[i]].decode().split("|")) for i in range(len(which))]
    df = spark.createDataFrame(rows, "i int, h string, a string, b string")
    for name in ("3|0|k", "13|1|p"):
        want = [r[1] for r in sorted(df.select("i", H.text_hash(F.col("h"), F.lit(name), F.col("a"), F.col("b"))).collect())]
        assert draws.draw(name, np.arange(len(which))).tolist() == want


def test_registered_features_have_the_panel(spark, folder, tmp_path):
    """Graph and text vectors both go through every detector."""
    orders = spark.read.parquet(f"{folder}/orders.parquet").where("o_custkey <= 4")
    lines = spark.read.parquet(f"{folder}/lineitem.parquet").withColumnRenamed("l_orderkey", "o_orderkey").join(orders, "o_orderkey", "left_semi").withColumnRenamed("o_orderkey", "l_orderkey")
    orders.write.parquet(f"{tmp_path}/orders.parquet")
    lines.write.parquet(f"{tmp_path}/lineitem.parquet")
    for name in ("customer", "supplier", "part", "nation"):
        (tmp_path / f"{name}.parquet").symlink_to(f"{folder}/{name}.parquet")
    got = entry_points.queries()["gra_features"](spark, str(tmp_path))
    scores = [*(f"label_{d}" for d in ("dbs", "lof", "ilf", "ocs")), *(f"pred_{d}" for d in ("lof", "ilf", "ocs", "km", "gm"))]
    assert {f"{p}_{s}" for p in ("graph", "graph_w2v") for s in scores} <= set(got.columns)
    assert got.count() == orders.count()
