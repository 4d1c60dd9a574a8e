"""Byte-level BPE: the library on the uncut text, a plain merge loop, and exact round trips."""

from __future__ import annotations

import base64
import hashlib
import random

import numpy as np
import pytest
import regex

from peerlens.llm import byte_bpe

tokenizers = pytest.importorskip("public_tokenizers")
SF = "/root/testdata/sf0.001"
FILE = tokenizers.path("byte_bpe_multi_50k.tiktoken")
DATA = open(FILE, "rb").read()
ENC = byte_bpe.encoding(DATA, tokenizers.PATTERN)
RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, DATA.splitlines())}


def merged(word: bytes) -> list[int]:
    parts = [word[i : i + 1] for i in range(len(word))]
    while len(parts) > 1:
        rank, i = min((RANKS.get(parts[i] + parts[i + 1], 1 << 40), i) for i in range(len(parts) - 1))
        if rank == 1 << 40:
            break
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return [RANKS[p] for p in parts]


def plain(text: str) -> list[int]:
    pattern = tokenizers.PATTERN.replace(r"[^\s\p{L}\p{N}]", rf"[^{byte_bpe.WHITE}\p{{L}}\p{{N}}]").replace(r"\s", f"[{byte_bpe.WHITE}]").replace(r"\S", f"[^{byte_bpe.WHITE}]")
    return [i for m in regex.finditer(pattern, text) for i in merged(m[0].encode())]


ODD = ["", " ", "  a", "it's 5's'5 don't", "ab12cd--34 ?!x", "a　b   c\x1c d\x85e", "日本語、テスト。123", "né́e 🙂🙂 \U0001f469‍\U0001f680", "\x00\x01", "<|endoftext|>", "a \n\n  b\t\tc   "]


def test_every_cut_is_safe():
    rng = random.Random(1)
    alphabet = list("ab's 1.\n\t-é") + ["　", "日", "🙂", "ll", "  "]
    for n in range(300):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60)))
        ids = [i for part, _ in byte_bpe.pieces(text, 1 + n % 7) for i in ENC.encode_ordinary(part)]
        assert "".join(p for p, _ in byte_bpe.pieces(text, 1 + n % 7)) == text
        assert ids == ENC.encode_ordinary(text) == plain(text)


@pytest.mark.parametrize("tail", ["", "x", ".", "\n"])
def test_long_texts(tail):
    for text in ["ab " * 60_000 + tail, " " * 3_000 + tail, "x" + " \n" * 2_000 + tail + " y", "a1" * 70_000 + tail]:
        assert byte_bpe.encode_text(ENC, text) == ENC.encode_ordinary(text)
    spaces = " " * 1_000_000 + tail  # more than the library takes at once
    ids = byte_bpe.encode_text(ENC, spaces)
    assert ENC.decode_bytes(ids) == spaces.encode()
    assert byte_bpe.encode_text(ENC, "word" * 100_000 + tail) == ENC.encode_ordinary("word" * 100_000 + tail)


def test_operator(spark):
    texts = [*ODD, None, "same", "same", " " * 50_000 + "end", "long text " * 40_000]
    rows = [(None if i == 3 else f"k{i // 2}", t, b"own", "x") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id string, text string, ids binary, decoded string").repartition(3)
    ranks = byte_bpe.ship_ranks(spark, FILE)
    got = byte_bpe.decode(byte_bpe.encode(docs, ranks, tokenizers.PATTERN), ranks, tokenizers.PATTERN).collect()
    want = [(r[0], np.array(byte_bpe.encode_text(ENC, t or ""), "<u4").tobytes(), (t or "").encode()) for r, t in zip(rows, texts, strict=True)]
    assert sorted(((r["doc_id"] or "", bytes(r["ids"]), bytes(r["decoded"])) for r in got)) == sorted((a or "", b, c) for a, b, c in want)
    assert byte_bpe.encode(docs.limit(0), ranks, tokenizers.PATTERN).count() == 0
    assert bytes(byte_bpe.decode(spark.createDataFrame([(1, None)], "doc_id long, ids binary"), ranks, tokenizers.PATTERN).collect()[0]["decoded"]) == b""


def test_query_against_plain_merges(spark):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = byte_bpe.op13_byte_bpe(spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = plain(texts[r["doc_id"]])
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()
