"""The training-data operators against plain versions on small inputs with nulls, empty texts, copies and clashing columns."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter, defaultdict

import brute
import numpy as np
import pytest
import xxhash

from peerlens.llm import decontam, langid, license_scan, mixing, pii, quality, simhash, suffix_dedup, suffix_tree, urlfilter

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def frame(spark, texts, **more):
    """doc_id, text, lang, source, n_chars and columns whose names the operators use themselves."""
    rows = [(i, t, "en", f"s{i % 2}", None if t is None else len(t), "x", "y", -1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string, copy string, label long").repartition(3)


def documents(spark):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


# SimHash


def plain_fingerprint(text):
    words = [w for w in WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))]
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else [" ".join(words)] * bool(words)
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_groups(prints, most):
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= most:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def test_simhash_matches_all_pairs(spark):
    texts = [t for _, t in documents(spark)] + [None, "", " \n", "Word", "word", "two words", "ÉTÉ été x", "a " * 300]
    got = {r["doc_id"]: r for r in simhash.near_duplicates(frame(spark, texts)).collect()}
    prints = [plain_fingerprint(t) for t in texts]
    assert [got[i]["fingerprint"] for i in range(len(texts))] == [f"{p:016x}" for p in prints]
    assert [got[i]["component_id"] for i in range(len(texts))] == plain_groups(prints, 2)


@pytest.mark.parametrize("most", [1, 2])
def test_simhash_chains_and_dense_buckets(spark, most):
    rng = random.Random(4)
    middle = rng.getrandbits(64)
    prints = {middle ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for _ in range(120)}
    prints |= {middle ^ x for x in range(200)}  # many members in one bucket
    prints |= {rng.getrandbits(64) for _ in range(60)}
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    nodes = spark.createDataFrame(list(zip(signed, range(len(prints)))), "fp long, label long")
    labels = {r["fp"]: r["label"] for r in simhash.components(nodes, simhash.links(nodes.select("fp"), most)).collect()}
    assert [labels.get(f, i) for i, f in enumerate(signed)] == plain_groups(prints, most)


def test_keep_first_keeps_one_of_each_group(spark):
    docs = frame(spark, ["a b c d", "a b c d", "other words entirely here", None, ""])
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 2, 3]


def test_keep_first_keeps_different_texts_of_null_and_repeated_ids(spark):
    a, b, c, d = "a b c d", "other words entirely here", "third text of this table", "and a fourth one too"
    rows = [(None, a), (None, b), (None, b), (None, c), (5, c), (5, d), (5, d), (4, d), (7, a), (7, "seven has a second text")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = sorted(((r["doc_id"], r["text"]) for r in simhash.keep_first(docs).collect()), key=str)
    assert kept == sorted([(7, a), (None, b), (5, c), (4, d), (7, "seven has a second text")], key=str)


# Repeated substrings


def test_deep_shallow_order():
    rng = random.Random(1)
    for _ in range(200):
        strings = list({bytes(rng.choices(b"ab", k=24)) for _ in range(rng.randint(1, 30))})
        strings = [b"common" + s for s in strings]
        assert [strings[i] for i in suffix_dedup.order(strings, 30, 6, 4)] == sorted(strings)


@pytest.mark.parametrize("group", [256, 1])
def test_repeats_match_all_windows(spark, group):
    rng = random.Random(7)
    words = lambda n: " ".join("".join(rng.choices(["the", "on", "er", "a", "in", "qu"], k=rng.randint(1, 3))) for _ in range(n))
    passages = [words(rng.randint(30, 120)) for _ in range(5)]
    texts = []
    for _ in range(90):
        r, t = rng.random(), words(rng.randint(0, 110))
        if r < 0.2 and texts:
            t = rng.choice(texts)
        elif r < 0.5:
            p = rng.choice(passages)
            t = f"{t} {p[: rng.randint(0, len(p))]} {words(rng.randint(0, 60))}"
        elif r < 0.6 and texts:
            p = rng.choice(texts) or "x"
            j = rng.randrange(len(p))
            t = f"{p[:j]}#{p[j + 1:]}"
        elif r < 0.65:
            t = "ab" * rng.randint(1, 400)
        elif r < 0.7:
            t = f"{t}{passages[0]} é {words(40)}{passages[0]}"
        texts.append(t)
    texts += ["", None, "x" * 199, "x" * 200, "x" * 201, words(3000)]
    got = {r["doc_id"]: r for r in suffix_dedup.repeats(frame(spark, texts), group=group).collect()}
    want = brute.repeated([(t or "").encode() for t in texts], 200)
    assert [tuple(got[i][c] for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256")) for i in range(len(texts))] == want
    assert all(sum(s["end"] - s["start"] for s in r["spans"]) == r["n_removed"] for r in got.values())


def test_anchors_of_long_texts_do_not_depend_on_pieces(monkeypatch):
    text = random.Random(3).randbytes(5000)
    whole = suffix_dedup.anchors(text)
    monkeypatch.setattr(suffix_dedup, "_PIECE", 700)
    assert (suffix_dedup.anchors(text) == whole).all()


# Language


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.fit(langid.training_rows(docs).select("doc_id", "text", "lang"))
    found = {r["doc_id"]: r for r in langid.identify(docs.withColumn("score", docs["source"]), model).collect()}
    held = [r for r in docs.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2 and len(r["text"]) > 100]
    assert sum(found[r["doc_id"]]["lang_pred"] == r["lang"] for r in held) >= 0.95 * len(held)
    odd = langid.identify(frame(spark, [None, "", "123 !!", "a"]), model)
    assert [(r["lang_pred"] == "und", 0 <= r["score"] <= 1) for r in odd.orderBy("doc_id").collect()] == [(True, True)] * 3 + [(False, True)]
    assert langid.fit(docs.where("false").select("doc_id", "text", "lang")) is None
    assert {r["lang_pred"] for r in langid.identify(docs.limit(3), None).collect()} == {"und"}
    assert langid.keep_recognised(frame(spark, [None, "", "the text"]), model).columns == frame(spark, [None]).columns


def test_kernel_counts_shared_grams():
    grams = lambda t: {(n, t[i : i + n]) for n in langid.NGRAMS for i in range(len(t) - n + 1)}
    texts = [b"the cat sat", b"the bat", b"", b"ab", b"the cat sat on the cat"]
    sets = [langid.grams(t) for t in texts]
    assert [len(s) for s in sets] == [len(grams(t)) for t in texts]
    vocabulary = np.unique(np.concatenate(sets))
    presence = np.zeros((len(vocabulary), len(sets)), bool)
    for j, s in enumerate(sets):
        presence[np.searchsorted(vocabulary, s), j] = True
    sizes = np.array([max(1, len(s)) for s in sets], float)
    model = langid.Model(["a"], vocabulary, np.packbits(presence, axis=1), sizes, np.eye(len(sets)), np.zeros((len(sets) + 1, 1)))
    want = [[len(grams(a) & grams(b)) / np.sqrt(max(1, len(grams(a))) * max(1, len(grams(b)))) for b in texts] for a in texts]
    assert np.allclose(model.kernel(texts), want)


# Licences


def test_license_phrases_and_notices(spark):
    texts = ["MIT License, mit-license mit", "Licensed under the Apach License Version 2.0", "permision is hereby grantd, free of charge, to any persons obtaining a copy", None, "", "no notice", "general public licenses", "Licensed under CC BY-NC 4.0."]
    got = [r for r in license_scan.scan(frame(spark, texts)).orderBy("doc_id").collect()]
    assert [(r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"], r["labels"]) for r in got] == [
        (5, 2, 0, 2, "mit", "mit"),
        (8, 0, None, None, "", "apache"),
        (13, 0, None, None, "", "mit"),
        (0, 0, None, None, "", ""),
        (0, 0, None, None, "", ""),
        (2, 0, None, None, "", ""),
        (3, 0, None, None, "", ""),
        (7, 0, None, None, "", "cc-by-nc"),
    ]
    assert [s["edits"] for s in got[2]["spans"]] == [3] and got[2]["spans"][0]["last_word"] == 12


def test_license_base_matches_regex(spark):
    docs = documents(spark)
    got = {r["doc_id"]: r for r in license_scan.scan(frame(spark, [t for _, t in docs])).collect()}
    for i, (_, t) in enumerate(docs):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), t))
        places = sorted((k, label) for phrase, label in license_scan.PHRASES for k in range(len(words)) if words[k : k + len(phrase.split())] == phrase.split())
        assert (got[i]["n_words"], got[i]["n_base"]) == (len(words), len(places))
        assert (got[i]["first_word"], got[i]["last_word"]) == ((places[0][0], places[-1][0]) if places else (None, None))


def test_license_seeds_lose_no_match():
    """Every place within the edits has a window: edited notices are found wherever they stand."""
    rng = random.Random(5)
    scanner = license_scan.Scanner()
    for i, (notice, label, k) in enumerate(scanner.notices):
        for _ in range(5):
            s = list(notice)
            for _ in range(rng.randint(0, k)):
                s[rng.randrange(1, len(s) - 1)] = rng.choice("abcdefgh")
            joined = f" some words before {''.join(s)} and after "
            assert any(x[0] == i and x[3] <= k for w in scanner.windows(joined) if w[0] == i for x in scanner._inside(joined, i, w[1], min(w[2], len(joined))))


# Language model


def test_suffix_tree_sums_to_one_and_matches_plain_walk(spark):
    texts = [t.encode().lower() for _, t in documents(spark)[:60]]
    depth = 3
    keys, n = suffix_tree._tally(suffix_tree.packed(texts, depth))
    total = np.zeros(257)
    counts = {d: defaultdict(lambda: np.zeros(257)) for d in range(1, depth + 1)}
    for key, k in zip(keys.tolist(), n.tolist()):
        total[key & 511] += k
        for d in range(1, depth + 1):
            counts[d][key >> 9 & (1 << 8 * d) - 1][key & 511] += k
    assert total.sum() == sum(len(t) + 1 for t in texts)
    often = {d: {c: v for c, v in rows.items() if v.sum() >= 40} for d, rows in counts.items()}
    tree = suffix_tree.grow(often, total, depth)
    width = tree.logp.shape[1]
    known = np.bincount(tree.classes, minlength=width)
    shares = 10 ** tree.logp[:, : width - 1]
    assert np.allclose((shares[:, : width - 2] * known[: width - 2]).sum(axis=1) + shares[:, width - 2], 1)
    tests = [b"", b"the", b"\xff\x00odd", texts[0], texts[1] * 7]
    plain = []
    for t in tests:
        state, sum_ = 0, 0.0
        for byte in bytes(depth):
            state = tree.step[state, tree.classes[byte]]
        for byte in t:
            sum_ += tree.logp[tree.out[state], tree.classes[byte]]
            state = tree.step[state, tree.classes[byte]]
        plain.append(sum_ + tree.logp[tree.out[state], width - 2])
    assert np.allclose(tree.scores(tests), plain)


def test_lm_scores(spark):
    texts = [t for _, t in documents(spark)] + [None, "", "neverseenword"]
    docs = frame(spark, texts)
    got = {r["doc_id"]: r for r in suffix_tree.score(docs, suffix_tree.crc_share("doc_id", 10) == 0, min_share=1e-4).collect()}
    held = [zlib.crc32(str(i).encode()) % 10 == 0 for i in range(len(texts))]
    tokens = [[*(t or "").encode().lower().split(), None] for t in texts]
    counts = Counter(w for h, ws in zip(held, tokens) if not h for w in ws)
    total, kinds = sum(counts.values()), len(counts)
    for i, ws in enumerate(tokens):
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[i], len(ws), sum(counts[w] > 0 for w in ws), total)
        assert r["base_score"] == pytest.approx(sum(np.log10((counts[w] + 0.1) / (total + 0.1 * (kinds + 1))) for w in ws))
        assert r["score"] < 0
    empty = suffix_tree.score(docs.where("false"), suffix_tree.crc_share("doc_id", 10) == 0)
    assert empty.count() == 0


# Decontamination


def test_banded_alignment():
    rng = random.Random(2)

    def plain(segment, region):
        row = [0] * (len(region) + 1)
        for i, c in enumerate(segment):
            new = [i + 1]
            for j, x in enumerate(region):
                new.append(min(row[j] + (c != x), row[j + 1] + 1, new[j] + 1))
            row = new
        return min(row)

    for _ in range(200):
        segment, region = bytes(rng.choices(b"abc", k=rng.randint(1, 15))), bytes(rng.choices(b"abc", k=rng.randint(0, 20)))
        assert decontam.best_inside(segment, region, -len(segment), len(region)) == plain(segment, region)


def test_decontamination_finds_edited_passages(spark):
    rng = random.Random(8)
    docs = [t for _, t in documents(spark)[:60]]
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = [t for t in docs if not any(b in t for _, b in bench)]
    dirty = []
    for i, (_, b) in enumerate(bench[:20]):
        s = list(b.lower() if i % 2 else b)
        for _ in range(len(s) // 30):
            s[rng.randrange(len(s))] = rng.choice("qxz ")
        dirty.append(f"{clean[i % len(clean)]} {''.join(s)} {clean[(i + 1) % len(clean)]}")
    texts = [*clean, *dirty, None, "", bench[0][1], bench[1][1] * 3, "word " * 30_000]
    benchmark = spark.createDataFrame([*bench, (None, "x" * 90), (900, None), (901, "short"), (902, bench[0][1])], "item_id long, text string")
    got = {r["doc_id"]: r for r in decontam.contamination(frame(spark, texts), benchmark, block_bytes=2000).collect()}
    n = len(clean)
    assert not any(got[i]["contaminated"] for i in range(n))
    assert all(str(bench[i][0]) in got[n + i]["item_ids"].split(",") for i in range(20))
    assert [got[n + 20 + i]["contaminated"] for i in range(5)] == [False, False, True, True, False]
    assert "902" in got[n + 22]["item_ids"].split(",") and got[n + 22]["min_edits"] == 0
    assert decontam.keep_clean(frame(spark, texts), benchmark).columns == frame(spark, [None]).columns
    assert not any(r["contaminated"] for r in decontam.contamination(frame(spark, texts[:5]), benchmark.where("false")).collect())


def test_decontamination_finds_passages_at_every_offset():
    rng = random.Random(11)
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 9)))
    item = " ".join(word() for _ in range(230))[:1100].encode().strip()
    other = [" ".join(word() for _ in range(80)).encode() for _ in range(2)]
    block = decontam.Block([(7, item), (8, item[:300])], decontam.EDIT_RATE, decontam.MIN_CHARS)
    for at in range(len(item) - 119):
        passage = bytearray(item[at : at + 120])
        found = block.matches(b" ".join([other[0], bytes(passage), other[1]]))
        assert 7 in found and (at > 180 or 8 in found), at
        for place in rng.sample(range(120), 12):  # as many replaced bytes as the edit budget
            passage[place] = ord("0")
        assert 7 in block.matches(b" ".join([other[0], bytes(passage), other[1]])), at
    assert not block.matches(b" ".join(other))
    assert not block.matches(b" ".join([other[0], item[200:280], other[1], item[600:680]]))


def test_windows_aligned_at_once_match_single_ones():
    rng = random.Random(12)
    for _ in range(100):
        part, region = bytes(rng.choices(b"abc", k=rng.randint(8, 30))), bytes(rng.choices(b"abc", k=rng.randint(1, 40)))
        m, low = rng.randint(3, 8), rng.randint(-12, 12)
        high = low + rng.randint(1, 12)
        starts = np.array(sorted(rng.sample(range(len(part) - m + 1), min(3, len(part) - m + 1))))
        want = [decontam.best_inside(part[s : s + m], region, low + s, high + s) for s in starts.tolist()]
        assert decontam.any_inside(part, starts, m, region, low, high).tolist() == want


# Personal data


def test_pii_base_matches_regex(spark):
    texts = [t for _, t in documents(spark)] + [None, "", "@", "a@b", "a@b.c@d.e", "x..@a-b.c.d, 1.2.3.4.5 300.1.1.1 001.02.3.4", "+1 (658) 555-3225 4111 1111 1111 1111", "+12", "a@" * 500, "9" * 3000, "é a@b.co ü 1.2.3.4"]
    got = {r["doc_id"]: r for r in pii.find(frame(spark, texts)).collect()}
    import hashlib

    for i, text in enumerate(texts):
        t = text or ""
        digits = lambda m: re.sub("[^0-9]", "", m.group())
        spans = [("email", m) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
        spans += [("ip", m) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m.group().split("."))]
        spans += [("card", m) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 16 <= len(digits(m)) <= 19 and pii.luhn(digits(m))]
        spans += [("phone", m) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(digits(m)) <= 15]
        joined = ",".join(f"{k}:{m.start()}:{m.end()}" for k, m in spans)
        assert got[i]["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest(), (i, t[:80])
        assert set(joined.split(",")) <= {*got[i]["spans"].split(","), ""}
        assert [got[i][f"n_{k}"] for k in pii.BASE] == [sum(x == k for x, _ in spans) for k in pii.BASE]


def test_pii_model_and_redaction(spark):
    text = 'token = "3f9a1c77b2e84d06a5c91e0f" and password=hunter2x9Q commit deadbeefdeadbeef, a@b.co internationalization'
    docs = frame(spark, [text, None, "clean text stays as it is"])
    counts = pii.vote_counts(docs)
    model = pii.fit(counts)
    kept = {k for k, _, _ in pii.all_spans(text, model, {})[1]}
    assert kept == {"secret"}
    out = {r["doc_id"]: r for r in pii.redact(docs, model).collect()}
    assert "3f9a1c77" not in out[0]["text"] and "<EMAIL>" in out[0]["text"] and "<SECRET>" in out[0]["text"]
    assert out[0]["n_chars"] == len(out[0]["text"]) and out[1]["text"] is None and out[2]["text"] == "clean text stays as it is"
    assert pii.redact(docs, model).columns == docs.columns
    assert 0 <= pii.fit({}).probability("4|0,0,0,0,0|0") <= 1


@pytest.mark.parametrize("length", [200, 201, 5_000])
def test_pii_long_secrets_are_hidden_whole(spark, length):
    rng = random.Random(length)
    key = "eyJ" + "".join(rng.choices("abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ23456789_-", k=length - 4)) + "x"
    docs = frame(spark, [f"password = {key}/end. and more", f"auth header {key} follows", f"{key}.{key}.{key}"])
    texts = [r["text"] for r in pii.redact(docs).orderBy("doc_id").collect()]
    assert texts == ["password = <SECRET> and more", "auth header <SECRET> follows", "<SECRET>.<SECRET>.<SECRET>"]


# Mixing


def test_mixing_counts_follow_the_targets(spark):
    docs = spark.range(6000).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 50 = 1 THEN NULL ELSE 'rest' END AS source", "'t' AS text")
    rate = {r["source"]: r["rate"] for r in mixing.rates(docs, {"hot": 3.0}).collect()}
    out = mixing.mix(docs, {"hot": 3.0}).collect()
    n = Counter(r["source"] for r in docs.collect())
    assert sum(rate[s] * n[s] for s in n) == pytest.approx(6000)
    made = Counter(r["source"] for r in out)
    for s in n:
        assert abs(made[s] - rate[s] * n[s]) < 5 * (rate[s] * n[s]) ** 0.5 + 1
    copies = Counter(r["doc_id"] for r in out if r["source"] == "hot")
    lam = rate["hot"]
    for k in range(4):
        want = 2000 * np.exp(-lam) * lam**k / np.prod(range(1, k + 1))
        seen = sum(1 for i in range(0, 6000, 3) if copies[i] == k)
        assert abs(seen - want) < 5 * want**0.5 + 2
    keys = [r["shuffle_key"] for r in out]
    assert keys == sorted(keys)


def test_mixing_large_rates_and_odd_rows(spark):
    one = spark.createDataFrame([(1, "a", "x"), (None, "a", None), (2, None, "")], "doc_id long, source string, copy string")
    made = mixing.mix(one, epochs=500.0).collect()
    assert abs(len(made) - 1500) < 250 and {r["source"] for r in made} == {"a", None}
    assert mixing.mix(one.where("false")).count() == 0
    again = mixing.mix(one.repartition(7), epochs=500.0, partitions=3).collect()
    assert sorted(map(str, made)) == sorted(map(str, again))


# Quality


def plain_repeat_words(words):
    n = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    return len({p for i in range(len(words) - 2) if n[tuple(words[i : i + 3])] > 1 for p in (i, i + 1, i + 2)})


def test_quality_counts_and_lines(spark):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(40)]
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 120))) for _ in range(60)]
    long = " ".join(f"u{i}" for i in range(60))
    texts += [f"Cookie  banner\n{long} {i}" for i in range(30)] + [f"Menu item {long}\n{long} x{i}" for i in range(30)]
    texts += [None, "", "\n\n", "a b c a b c", "a a a a", "one\none\n one", "# $ é\tü"]
    got = {r["doc_id"]: r for r in quality.quality(frame(spark, texts)).collect()}
    norm = lambda x: " ".join(WORD.findall(x.lower()))
    lines = [[x for x in (t or "").split("\n") if WORD.search(x)] for t in texts]
    hosts = Counter(i % 2 for i in range(len(texts)))
    seen = Counter((i % 2, x) for i, ls in enumerate(lines) for x in {norm(x) for x in ls})
    for i, t in enumerate(texts):
        ws = WORD.findall(t or "")
        chars = sum(map(len, ws))
        lost = sum(sum(map(len, WORD.findall(x))) for x in lines[i] if seen[i % 2, norm(x)] > max(10, 0.01 * hosts[i % 2]))
        failed = len(ws) < 50 or 100 * plain_repeat_words(ws) > 50 * len(ws)
        want = (len(ws), chars, sum((t or "").count(c) for c in "#*$%&|<>"), len(lines[i]) - len(set(lines[i])), plain_repeat_words(ws), failed, lost, not failed and lost <= chars * 0.5)
        assert tuple(got[i][c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_line_chars", "kept")) == want, i


def test_quality_removes_boilerplate_lines(spark):
    own = [" ".join(f"w{i}x{k}" for k in range(60)) for i in range(30)]
    texts = [f"{o}\n\nSubscribe  NOW to our letter\n tail {i}" for i, o in enumerate(own)] + [None, "", "subscribe now to our letter", "kept \n"]
    docs = frame(spark, texts)
    got = {r["doc_id"]: r for r in quality.quality(docs, clean=True).collect()}
    assert [got[i]["clean_text"] for i in range(len(texts))] == [f"{o}\n\n tail {i}" for i, o in enumerate(own)] + [None, "", "", "kept \n"]
    assert all(got[i]["kept"] and got[i]["n_line_chars"] > 0 for i in range(30))
    assert quality.quality(docs).columns == [c for c in got[0].asDict() if c != "clean_text"]


# URLs


def test_url_rules_match_plain_scan(spark):
    rng = random.Random(9)
    urls = [f"http{rng.choice(['', 's'])}://{rng.choice(['', 'www.', 'a.b.'])}{rng.choice(['example.org', 'Example.ORG', 'x.com', 'notexample.org', 'org', 'com', 'y.net'])}{rng.choice(['/es/', '/en/1', '/en/19?x', '/fr/#a', '/de/', '', '?q=/de/', '/e'])}{rng.randint(0, 9)}" for _ in range(300)]
    urls += [None, "", "no scheme.org/de/", "://", "://org/", "x://a://com/de/", "http://exämple.com/de/ü"]
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, verdict string")
    rules = [*urlfilter.RULES, *((f"h{i}.net", f"/p{i}", "block") for i in range(200))]
    got = {r["page_id"]: r for r in urlfilter.judge(pages, rules).collect()}
    for i, u in enumerate(urls):
        m = re.search(r"://([^/?#]*)([^?#]*)", u or "", re.S)
        host, path = (re.sub("[A-Z]", lambda x: x.group().lower(), m[1]), m[2]) if m else ("", "")
        fits = [(len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        _, rule, verdict = max(fits, default=(0, None, "allow"))
        assert tuple(got[i][c] for c in ("host", "path", "rule", "verdict")) == (host, path, rule, verdict), u


def test_cascade_is_exact_for_its_universe(spark):
    rules = [(f"h{i}.org", "/", "block") for i in range(50)]
    keys = [f"h{i}.org/".encode() for i in range(3000)]
    levels = urlfilter.cascade_of(rules, spark.createDataFrame([(bytearray(k),) for k in keys], "key binary"))
    assert len(levels) > 1
    assert [urlfilter.holds(levels, k) for k in keys] == [i < 50 for i in range(3000)]


@pytest.mark.parametrize("run", [simhash.near_duplicates, suffix_dedup.repeats, quality.quality, license_scan.scan, pii.find, mixing.mix, lambda d: langid.identify(d, None), lambda d: suffix_tree.score(d, suffix_tree.crc_share("doc_id", 10) == 0)])
def test_empty_tables_and_null_ids(spark, run):
    docs = frame(spark, ["one two three"]).where("false")
    assert run(docs).count() == 0
    odd = spark.createDataFrame([(None, "some words here", None, None, None), (None, None, None, None, None), (7, "some words here", None, None, None), (7, "some words here", None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    if run is mixing.mix:
        run(odd).collect()
    else:
        assert run(odd).count() == 4
