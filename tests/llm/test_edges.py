"""Null and repeated ids, clashing names, hot hosts, near copies: what no operator or stage may lose or take for another."""

from __future__ import annotations

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from peerlens.llm import decontam, langid, license_scan, mixing, pii, quality, simhash

SF = "/root/testdata/sf0.01"
CLASH = ("_row", "_row_", "_found", "_count", "_cdf", "_parts", "_rate_key", "score", "row", "label", "order", "host", "text_", "same")


def clashing(spark, texts, ids=None):
    rows = [(ids[i] if ids else i, t, "en", f"s{i % 2}", 1, *[f"{c}{i}" for c in CLASH]) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASH)).repartition(3)


TEXTS = ["alpha beta gamma delta epsilon zeta eta theta"] * 3 + [f"word{i} " * 3 + f"other{i} thing{i} more{i}" for i in range(20)] + [None, "", None]


def whole(df, columns):
    return sorted(df.select(*columns).collect(), key=str)


@pytest.mark.parametrize("stage", [mixing.mix, simhash.keep_first, simhash.keep_dissimilar, pii.redact, lambda d: decontam.keep_clean(d, d.sparkSession.createDataFrame([(1, "nothing of this is in any text of the table at all, not one word")], "item_id long, text string")), lambda d: langid.keep_recognised(d, None)])
@pytest.mark.parametrize("ids", ["own", "null", "repeated"])
def test_own_columns_survive(spark, stage, ids):
    docs = clashing(spark, TEXTS, {"own": None, "null": [None] * len(TEXTS), "repeated": [7] * len(TEXTS)}[ids])
    out = stage(docs)
    names = [c for c in docs.columns if c in out.columns]
    assert set(names) == set(docs.columns)
    before = {str(r) for r in whole(docs, names)}
    got = whole(out, names)
    assert {str(r) for r in got} <= before  # whole rows, each column its own value
    if stage in (simhash.keep_first, simhash.keep_dissimilar):
        assert len(got) == 22  # three copies are one, the wordless are one
    if stage is pii.redact:
        assert len(got) == len(TEXTS)
    assert stage(docs.where("false")).count() == 0


def test_rows_without_an_id_are_drawn_each(spark):
    docs = spark.range(4000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("same text").alias("text"), F.lit("s").alias("source"))
    for seed in (11, 12):
        out = mixing.mix(docs, seed=seed)
        assert 3700 < out.count() < 4300
        sizes = [len(p) for p in out.rdd.glom().collect()]
        assert max(sizes) < 0.5 * sum(sizes)
    known = docs.withColumn("doc_id", F.monotonically_increasing_id())
    some = docs.limit(10).unionByName(known)
    assert 3700 < mixing.mix(some).where("doc_id IS NOT NULL").count() < 4300


def sets(texts, words=5):
    out = []
    for t in texts:
        w = (t or "").encode().lower().split()
        out.append({tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) > words else {tuple(w)})
    return out


def test_near_copies_by_similarity(spark):
    """Every pair of similarity 0.8 or more loses a member or both are joined to one that stays; clean documents stay."""
    rng = random.Random(6)
    texts = []
    for i in range(60):
        base = [f"w{rng.randint(0, 4000)}" for _ in range(rng.randint(60, 400))]
        texts.append(" ".join(base))
        for edits in (1, 3, len(base) // 60):
            copy = list(base)
            for _ in range(edits):
                copy[rng.randrange(len(copy))] = f"x{rng.randint(0, 10**9)}"
            texts.append(" ".join(copy))
    texts += [texts[0].upper(), "  " + texts[0].replace(" ", "\n"), "too short", "Too  short", "too long", None, ""]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(5)
    kept = {r["doc_id"] for r in simhash.keep_dissimilar(docs).collect()}
    plain = sets(texts)
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if len(plain[i] & plain[j]) >= 0.8 * len(plain[i] | plain[j])]
    missed = [p for p in pairs if p[0] in kept and p[1] in kept]
    assert len(missed) <= 0.02 * len(pairs)
    group = list(range(len(texts)))
    for _ in range(10):
        for i, j in pairs:
            group[i] = group[j] = min(group[i], group[j])
    assert {i for i in range(len(texts)) if group[i] == i} <= kept  # no clean document goes


def test_no_pair_at_the_threshold_is_left_out(spark):
    """Pairs of similarity just above 0.8, of any length: what stays is one text of each of the groups that brute force finds."""
    rng = random.Random(11)
    texts = []
    while len(texts) < 1000:
        base = [f"w{rng.randint(0, 10**6)}" for _ in range(rng.choice([8, 9, 12, 20, 33, 60, 100, 240]))]
        cut = rng.randint(0, len(base) // 5)
        texts += [" ".join(base), " ".join(base[cut:])]
        copy = list(base)
        copy[len(base) // 2 : len(base) // 2 + max(1, len(base) // 10 - 4)] = ["other"]
        texts.append(" ".join(copy))
    plain = sets(texts)
    group = list(range(len(texts)))
    near = lambda i, j: len(plain[i] & plain[j]) >= 0.8 * len(plain[i] | plain[j])
    for i in range(0, len(texts), 3):
        members = range(i, min(i + 3, len(texts)))
        for _ in members:
            for a in members:
                for b in members:
                    if near(a, b):
                        group[a] = group[b] = min(group[a], group[b])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    assert {r["doc_id"] for r in simhash.keep_dissimilar(docs).collect()} == {i for i, g in enumerate(group) if i == g}


def test_similar_sets_share_a_key_and_pairs_cross_labels_only():
    import numpy as np

    rng = np.random.default_rng(3)
    draw = lambda n: np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
    for n in [*range(4, 40), 100, 301, 999]:
        for _ in range(10):
            x = draw(n)
            gone = int(rng.integers(0, n // 5 + 1))
            more = int((n - gone) / 0.8 - n)
            y = np.unique(np.concatenate([rng.permutation(x)[gone:], draw(max(more, 0)) if more > 0 else x[:0]]))
            if len(np.intersect1d(x, y)) >= 0.8 * len(np.union1d(x, y)) and not np.array_equal(x, y):
                assert len(np.intersect1d(simhash.part_keys(x, 0.8), simhash.part_keys(y, 0.8)))
    keys, labels = np.array([1, 1, 1, 2, 3, 3, 3, 3]), np.array([5, 5, 6, 7, 1, 1, 2, 3])
    found = {(i, j) for a, b, _ in simhash._cross_pairs(keys, labels) for i, j in zip(a.tolist(), b.tolist(), strict=True)}
    assert found == {(0, 2), (1, 2), (4, 6), (4, 7), (5, 6), (5, 7), (6, 7)}
    found = {(i, j, d) for a, b, d in simhash._cross_pairs(keys, labels, 1) for i, j in zip(a.tolist(), b.tolist(), strict=True)}
    assert found == {(0, 2, False), (1, 2, False), (4, 4, True), (4, 5, True), (4, 6, True), (4, 7, True)}


def test_keys_of_sets_are_few_and_lose_no_similar_pair():
    """Of a set of n hashes a fifth and one are sent, rare ones first; likely pairs hold every similar pair of different labels."""
    import numpy as np

    rng = np.random.default_rng(7)
    common = np.unique(rng.integers(0, 1 << 63, 300, dtype=np.uint64))
    counts = rng.integers(3, 900, len(common))
    sets = []
    for n in [4, 5, 9, 20, 57, 100, 240]:
        for _ in range(12):
            base = np.concatenate([rng.integers(0, 1 << 63, n - n // 3, dtype=np.uint64), rng.permutation(common)[: n // 3]])
            sets += [np.unique(rng.permutation(base)[int(rng.integers(0, n // 6 + 1)) :]) for _ in range(3)]
    keys = [simhash.part_keys(s, 0.8, common, counts) for s in sets]
    assert all(len(k) <= len(s) // 5 + 1 for k, s in zip(keys, sets, strict=True))
    held = [(int(k), i, i, len(sets[i]), at) for i, own in enumerate(keys) for at, k in enumerate(own)]
    columns = [np.array(c) for c in zip(*sorted(held), strict=True)]
    found = {(min(a, b), max(a, b)) for x, y, dense in simhash._likely_pairs(*columns, 0.8) for a, b in zip(x.tolist(), y.tolist(), strict=True)}
    for i in range(len(sets)):
        for j in range(i):
            shared = len(np.intersect1d(sets[i], sets[j]))
            if shared >= 0.8 * (len(sets[i]) + len(sets[j]) - shared) and not np.array_equal(sets[i], sets[j]):
                assert (j, i) in found
            differ = int(np.bitwise_count((simhash.parity_marks(sets[i]) ^ simhash.parity_marks(sets[j])).view(np.uint64)).sum())
            assert differ <= len(sets[i]) + len(sets[j]) - 2 * shared


def test_a_large_group_of_loose_copies_is_compared_whole(spark, monkeypatch):
    """Copies of one text with a few changed words, mostly just below the threshold to each other: groups as by brute force."""
    monkeypatch.setattr(simhash, "DENSE", 4)
    monkeypatch.setattr(simhash, "TILE_ROWS", 16)
    rng = random.Random(12)
    base = [f"w{i}" for i in range(80)]
    texts = []
    for _ in range(120):
        copy = list(base)
        for _ in range(2):
            copy[rng.randrange(len(copy))] = f"x{rng.randint(0, 3)}"
        texts.append(" ".join(copy))
    plain = sets(texts)
    group = list(range(len(texts)))
    for _ in range(20):
        for i in range(len(texts)):
            for j in range(i):
                if len(plain[i] & plain[j]) >= 0.8 * len(plain[i] | plain[j]):
                    group[i] = group[j] = min(group[i], group[j])
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert {r["doc_id"] for r in simhash.keep_dissimilar(docs).collect()} == {i for i, g in enumerate(group) if i == g}
    hashed = spark.createDataFrame([(0, i, i, bytearray(simhash.shingle_set(t.encode(), 5).tobytes())) for i, t in rows], "block long, row long, label long, hashes binary")
    found = {(min(r["a"], r["b"]), max(r["a"], r["b"])) for r in simhash.dense_links(hashed).collect()}
    assert found == {(j, i) for i in range(len(texts)) for j in range(i) if len(plain[i] & plain[j]) >= 0.8 * len(plain[i] | plain[j])}


def test_recall_on_the_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    plain = sets([t for _, t in rows])
    by = defaultdict(list)
    for i, s in enumerate(plain):
        for x in s:
            by[x].append(i)
    shared = defaultdict(int)
    for ids in by.values():
        for a in range(len(ids)):
            for b in range(a):
                shared[ids[b], ids[a]] += 1
    pairs = [p for p, n in shared.items() if n >= 0.8 * (len(plain[p[0]]) + len(plain[p[1]]) - n)]
    kept = {r["doc_id"] for r in simhash.keep_dissimilar(docs).select("doc_id").collect()}
    found = sum(not (rows[a][0] in kept and rows[b][0] in kept) for a, b in pairs)
    assert pairs and found >= 0.9 * len(pairs)
    in_pair = {x for p in pairs for x in p}
    assert all(i in kept for n, (i, _) in enumerate(rows) if n not in in_pair)


def test_large_group_of_near_copies_is_linked_through_leaders():
    """Many different texts of one template: one link a member, whatever its group."""
    import numpy as np

    rng = random.Random(1)
    base = [f"w{i}" for i in range(200)]
    prints = []
    for _ in range(600):
        copy = list(base)
        copy[rng.randrange(200)] = f"x{rng.random()}"
        prints.append(simhash.wide_fingerprint(simhash.shingle_set(" ".join(copy).encode(), 5), 2).view(">u8").astype(np.uint64))
    leader, row, bits, leaders = simhash._large_bucket(np.array(prints), simhash.RADIUS)
    assert sorted(row) == list(range(1, 600)) and bits.max() <= simhash.RADIUS and set(leader) <= set(leaders)
    assert len(leaders) < 40


def test_boilerplate_limit_does_not_grow_with_the_host(spark):
    line = "Subscribe now to our letter and read the best of the week"
    own = lambda i: " ".join(f"w{i}x{k}" for k in range(60))
    rows = [(i, f"{own(i)}\n{line}" if i < 30 else own(i), "hot") for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = quality.quality(docs).where("n_line_chars > 0")
    assert got.count() == 30  # 0.5 % of the host's documents


def test_language_model_of_long_texts_only(spark):
    words = {"en": "the quick brown fox jumps over the lazy dog and runs ", "de": "der schnelle braune fuchs springt über den faulen hund "}
    rows = [(i, words[lang] * 600, lang) for i, lang in enumerate(["en", "de"] * 6)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    short = spark.createDataFrame([(1, "over the lazy dog and the brown fox", None), (2, "über den faulen braunen hund", None), (3, "эта собака бежит очень быстро", None), (4, "12 34", None), (5, None, None)], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r["lang_pred"] for r in langid.identify(short, model).collect()}
    assert got[1] == "en" and got[2] == "de" and got[4] == got[5] == langid.UNKNOWN
    kept = {r["doc_id"] for r in langid.keep_recognised(short, model, least=0.6).collect()}
    assert kept == {1, 2}  # an unknown script has no sure language


def test_scan_keeps_ids_of_clashing_tables(spark):
    assert license_scan.scan(clashing(spark, ["MIT license"])).count() == 1
