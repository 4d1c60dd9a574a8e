"""Ranked search against scores of all documents, with small shards, blocks and windows."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import pytest

from peerlens.llm import maxscore

SF = "/root/testdata/sf0.001"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, k=20):
    """(item, rank, doc, score) with every document scored."""
    counts = [(i, Counter(terms(t))) for i, t in docs]
    counts = [(i, c, sum(c.values())) for i, c in counts if c]
    n, total = len(counts), sum(x[2] for x in counts)
    df = Counter(t for _, c, _ in counts for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c, size in counts:
            m = 100 - 25 + (25 * size * n) // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 12 * m)) for t in terms(text) if t in c)
            if score > 0:
                scores.append((-score, i is None, i or 0))
        out += [(item, r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scores)[:k])]
    return out


def rows(df):
    return sorted((tuple(r[c] for c in ("item_id", "rank", "doc_id", "score")) for r in df.collect()), key=lambda r: (str(r[0]), r[1]))


@pytest.mark.parametrize("shard_bytes,window,query_block", [(1 << 20, 512, 50_000), (3_000, 7, 50), (40_000, 64, 20)])
def test_search_equals_scoring_all(spark, shard_bytes, window, query_block):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(60)] + ["É", "日本", "x1"]
    texts = [" ".join(rng.choices(words, weights=[1000 // (i + 1) for i in range(63)], k=rng.randint(0, 80))) for _ in range(400)]
    texts += [None, "", "., !", "W1 w1 W1", "w1 w2 " * 3000, texts[5], texts[5], texts[5]]
    docs = [(None if i % 97 == 3 else i // 2 * 2 if i > 390 else i, t) for i, t in enumerate(texts)]
    items = [(i, " ".join(rng.choices(words, k=rng.randint(1, 25)))) for i in range(25)] + [(90, None), (91, "nothing here"), (92, "w1 w1 w1 w2"), (93, "日本 É")]
    d = spark.createDataFrame([(*x, "own", 1) for x in docs], "doc_id long, text string, term string, score int").repartition(3)
    q = spark.createDataFrame([(*x, "own") for x in items], "item_id long, text string, item string")
    index = maxscore.build_index(d, shard_bytes=shard_bytes)
    assert rows(maxscore.search(index, q, query_block=query_block, window=window)) == sorted(plain(docs, items), key=lambda r: (str(r[0]), r[1]))


def test_edges(spark):
    d = spark.createDataFrame([(1, "a b"), (2, "a"), (2, "a"), (3, None)], "doc_id long, text string")
    q = spark.createDataFrame([(None, "a b"), (7, "b"), (7, "b"), (8, None)], "item_id long, text string")
    got = rows(maxscore.search(maxscore.build_index(d), q))
    assert [r[:3] for r in got] == [(7, 1, 1), (7, 1, 1), (None, 1, 1), (None, 2, 2), (None, 3, 2)]
    assert maxscore.search(maxscore.build_index(d.limit(0)), q).count() == 0
    assert maxscore.search(maxscore.build_index(d), q.limit(0)).count() == 0


def opened(docs, query, k, window):
    """(blocks opened, blocks in the lists asked for) for one shard."""
    import numpy as np
    import pyarrow as pa

    row = maxscore.shard_row("0", [(i, Counter(t), len(t)) for i, t in enumerate(docs)])
    total = sum(map(len, docs))
    asked = pa.array(sorted(set(query)), pa.string())
    shard = maxscore.Shard(row | {"df": row["df"]}, asked, (len(docs), total))
    df = {t.as_py(): int(n) for t, n in zip(row["terms"], row["df"], strict=True)}
    weights = np.array([math.floor(1000 * math.log((2 * len(docs) + 2) / (2 * df[t.as_py()] + 1))) for t in asked])
    shard.top(np.arange(len(asked)), weights, k, window)
    return len(shard.open), sum(-(-df[t.as_py()] // maxscore.BLOCK) for t in asked)


def test_blocks_are_skipped():
    rng = random.Random(2)
    docs = [[t.encode() for t in ["the"] * rng.randint(0, 3) + ["of"] * rng.randint(0, 2) + rng.choices([f"r{i}" for i in range(2000)], k=5)] for _ in range(20_000)]
    docs = [d for d in docs if d]
    rare = [f"r{i}" for i in range(6)]
    docs = [[t.encode() for t in rare]] * 5 + docs  # raise the k-th score early
    seen, held = opened(docs, ["the", "of", *rare], 5, 512)
    assert seen < held / 4


def test_query(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert rows(maxscore.op11_ranked_search(spark, SF)) == sorted(plain(docs, items), key=lambda r: (str(r[0]), r[1]))
