"""Byte-level BPE with the tiktoken library and a local rank file: texts to ids, and ids back to raw bytes.

The library is given pieces of a text, not the whole: a long text is cut at places that no match of the splitting pattern
can cross, and a long run of white space, on which the library's regex engine overflows its stack, is handed over as the one
match it is. The ids are those of the uncut text. The rank file is read once by the driver (``MAX_RANK_BYTES`` at most) and
broadcast; each Python worker builds its tables once. Nothing is shuffled.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peerlens.llm.common import batches, table

#: Characters after which the next safe place cuts a text, and white space that is a run of its own.
CHUNK, RUN = 1 << 16, 1 << 10
MAX_RANK_BYTES = 64 << 20

#: The characters of Unicode's White_Space, the pattern's \s. (Python's own \s has four more.)
WHITE = r"\t\n\x0B\x0C\r \x85\xA0  -     　"

# No alternative of the pattern holds white space after anything else, a digit after an ASCII letter, or
# ASCII punctuation and then a digit; and none looks further than the end of the white space it holds.
_SAFE = regex.compile(rf"(?<=[^{WHITE}])(?=[{WHITE}])|(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])|(?<=[!-/:-@\[-`{{-~])(?=[0-9])|(?<=[{WHITE}])(?=[{WHITE}][^{WHITE}])")
_RUN = regex.compile(rf"[{WHITE}]{{{RUN},}}+")

_BUILT: dict[bytes, tiktoken.Encoding] = {}


def encoding(rank_file: bytes, pattern: str) -> tiktoken.Encoding:
    """The library's encoding of a rank file (lines of base64 token and rank), built once per process."""
    key = hashlib.sha256(rank_file + b"\0" + pattern.encode()).digest()
    if key not in _BUILT:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in rank_file.splitlines() if line.strip())}
        _BUILT[key] = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _BUILT[key]


def pieces(text: str, chunk: int = CHUNK) -> Iterator[tuple[str, bool]]:
    """(piece, whether it is exactly one match); the pieces make up the text, and no match crosses a border.

    Without a safe place a piece is as long as it has to be.
    """
    at = 0
    for run in _RUN.finditer(text):
        # The last character of a run belongs to what follows it, unless the text ends.
        start, end = run.start(), run.end() - (run.end() < len(text))
        yield from ((part, False) for part in _cut(text, at, start, chunk))
        yield text[start:end], True
        at = end
    yield from ((part, False) for part in _cut(text, at, len(text), chunk))


def _cut(text: str, at: int, end: int, chunk: int) -> Iterator[str]:
    while end - at > chunk:
        safe = _SAFE.search(text, at + chunk, end)
        if safe is None:
            break
        yield text[at : safe.start()]
        at = safe.start()
    if at < end:
        yield text[at:end]


def encode_text(enc: tiktoken.Encoding, text: str, chunk: int = CHUNK) -> list[int]:
    """The ids of a whole text without special tokens. It assumes a splitting pattern of the kind described above."""
    if len(text) < RUN:
        return enc.encode_ordinary(text)
    ids: list[int] = []
    for part, single in pieces(text, chunk):
        ids += enc._encode_single_piece(part) if single else enc.encode_ordinary(part)
    return ids


def ship_ranks(spark: SparkSession, path: str) -> Broadcast:
    """The rank file's bytes for all workers; a file beyond ``MAX_RANK_BYTES`` is refused."""
    with open(path, "rb") as f:
        data = f.read(MAX_RANK_BYTES + 1)
    if len(data) > MAX_RANK_BYTES:
        raise ValueError(f"rank file over {MAX_RANK_BYTES} bytes: {path}")
    return spark.sparkContext.broadcast(data)


def encode(docs: DataFrame, ranks: Broadcast, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids): the ids of each text as little-endian unsigned 32-bit integers, one row per input row.

    A null text is an empty one and has no ids. Ids of rows may be null or repeated, and of any type. Other columns are
    not looked at. A text of any length is encoded whole.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        enc = encoding(ranks.value, pattern)
        found = [np.array(encode_text(enc, t or ""), "<u4").tobytes() for t in batch.column(1).to_pylist()]
        return pa.record_batch([batch.column(0), pa.array(found, pa.binary())], [id_col, "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return batches(docs.select(F.col(id_col), F.col(text_col).cast("string").alias("_text")), run, f"`{id_col}` {kind}, ids binary")


def decode(coded: DataFrame, ranks: Broadcast, pattern: str) -> DataFrame:
    """The input's columns and ``decoded``, the raw bytes of ``ids``; they need not be valid UTF-8. Null ids give no bytes.

    Ids outside the rank file, or a length that is no multiple of four, are an error. A column ``decoded`` is replaced.
    """
    coded = coded.drop("decoded")
    place = coded.columns.index("ids")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        enc = encoding(ranks.value, pattern)
        found = [enc.decode_bytes(np.frombuffer(ids or b"", "<u4").tolist()) for ids in batch.column(place).to_pylist()]
        return pa.record_batch([*batch.columns, pa.array(found, pa.binary())], [*batch.schema.names, "decoded"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in coded.schema.fields)
    return batches(coded, run, f"{fields}, decoded binary")


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, encoded and decoded again by the multilingual rank file."""
    import public_tokenizers

    ranks = ship_ranks(spark, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    both = decode(encode(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN), ranks, public_tokenizers.PATTERN)
    return both.select(
        "doc_id", F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


QUERIES = {"op13_byte_bpe": op13_byte_bpe}
SQL: dict[str, str] = {}
