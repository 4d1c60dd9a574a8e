"""Language identification with string kernels.

Kernel of two texts: the blended spectrum, how many distinct byte n-grams (n = 3, 4, 5, of the lower-cased text)
both have, over the geometric mean of how many each has. A few landmark texts per language span a Nyström feature
space, one-versus-rest kernel ridge regression is solved in it, and batches of texts are scored by two matrix
products: n-gram presence times landmark presence, then times the weights.

Fitting: bounded samples. ``landmarks`` texts per language are collected (each of at most ``landmark_bytes`` bytes),
and ``sample`` labelled texts per language, whole, give the ridge sums; both are documented parameters and chosen by
hash among the training rows. Scoring reads every text whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from peerlens.llm.common import aside, crc_share, streams, table

NGRAMS = (3, 4, 5)
LANDMARKS, LANDMARK_BYTES = 8, 20_000
SAMPLE = 1_500
#: A document whose best language has a smaller score is rejected by ``keep_recognised``.
LEAST_SCORE = 0.35
RIDGE = 1e-3
UNKNOWN = "und"
_TABLE_BITS = 20
#: Distinct n-grams of very long texts are gathered in pieces of this many bytes.
_PIECE = 1 << 20


def grams(text: bytes) -> np.ndarray:
    """Distinct n-grams of a lower-cased text as sorted numbers: the bytes of the n-gram, and n above them."""
    found = []
    for at in range(0, max(1, len(text)), _PIECE):
        piece = np.frombuffer(text[at : at + _PIECE + max(NGRAMS) - 1], np.uint8).astype(np.uint64)
        last = at + _PIECE >= len(text)
        packed = piece.copy()
        for n in range(2, max(NGRAMS) + 1):
            packed = (packed[:-1] << np.uint64(8)) | piece[n - 1 :]
            if n in NGRAMS:
                own = packed if last else packed[:_PIECE]
                found.append(own | np.uint64(n << 56))
    every = np.concatenate(found)
    every.sort()
    keep = np.empty(len(every), bool)
    keep[:1] = True
    np.not_equal(every[1:], every[:-1], out=keep[1:])
    return every[keep]


def _slot(keys: np.ndarray, level: int) -> np.ndarray:
    return (keys * np.uint64(0x9E3779B97F4A7C15 + 2 * level * 0x632BE59BD9B4E019 & (1 << 64) - 1)) >> np.uint64(64 - _TABLE_BITS)


def _lower(column: pa.Array) -> list[bytes]:
    return [(x or "").lower().encode() for x in column.to_pylist()]


_BITS_OF = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


@dataclass
class Model:
    """``vocabulary``: n-grams of the landmarks; ``presence``: vocabulary x landmarks, in bits; ``weights``: landmarks x languages."""

    languages: list[str]
    vocabulary: np.ndarray
    presence: np.ndarray
    sizes: np.ndarray
    root: np.ndarray
    weights: np.ndarray

    def __post_init__(self) -> None:
        # Hash tables from n-gram to row; a key whose slot is taken goes to the next table.
        self.tables = []
        rest = np.arange(len(self.vocabulary), dtype=np.int32)
        while len(rest):
            slots = _slot(self.vocabulary[rest], len(self.tables))
            rows = np.full(1 << _TABLE_BITS, -1, np.int32)
            rows[slots] = rest
            self.tables.append(rows)
            rest = rest[rows[slots] != rest]

    def places(self, own: np.ndarray) -> np.ndarray:
        """Rows of those n-grams that are in the vocabulary."""
        found = [np.zeros(0, np.int32)]
        for level, rows in enumerate(self.tables):
            at = rows[_slot(own, level)]
            taken = at >= 0
            at, own = at[taken], own[taken]
            same = self.vocabulary[at] == own
            found.append(at[same])
            own = own[~same]
        return np.concatenate(found)

    def kernel(self, texts: list[bytes]) -> np.ndarray:
        """texts x landmarks."""
        shared = np.zeros((len(texts), len(self.sizes)))
        sizes = np.ones(len(texts))
        for i, text in enumerate(texts):
            own = grams(text)
            sizes[i] = max(1, len(own))
            # One row of the product presence(texts) x presence(landmarks): equal bytes of bits are counted, then unpacked.
            bits = self.presence[self.places(own)]
            counts = np.vstack([np.bincount(bits[:, j], minlength=256) for j in range(bits.shape[1])])
            shared[i] = (counts @ _BITS_OF).ravel()[: len(self.sizes)]
        return shared / np.sqrt(sizes[:, None] * self.sizes[None, :])

    def features(self, texts: list[bytes]) -> np.ndarray:
        return self.kernel(texts) @ self.root

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """texts x languages: about 1 for the text's language and -1 for others."""
        return np.hstack([self.features(texts), np.ones((len(texts), 1))]) @ self.weights


def _sampled(rows: DataFrame, counts: dict[str, int], most: int, seed: int) -> DataFrame:
    """Up to about ``most`` rows per language by hash."""
    want: Column = F.lit(0.0)
    for lang, n in counts.items():
        want = F.when(F.col("lang") == lang, F.lit(min(1.0, most / n))).otherwise(want)
    unit = F.pmod(F.xxhash64(F.lit(seed), "doc_id", "text"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return rows.where(unit < want)


def fit(train: DataFrame, landmarks: int = LANDMARKS, sample: int = SAMPLE, ridge: float = RIDGE, landmark_bytes: int = LANDMARK_BYTES, seed: int = 7) -> Model | None:
    """Model of (doc_id, text, lang) rows; rows with a null language or without letters teach nothing. None if nothing is left."""
    rows = train.where(F.col("lang").isNotNull() & F.coalesce(F.col("text"), F.lit("")).rlike(r"\p{L}"))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    languages = sorted(counts)
    rows = aside(_sampled(rows.select("doc_id", "text", "lang"), counts, sample, seed), "langid-sample")
    # Landmarks: the first in hash order among texts longer than a few words, where there are any, and of a bounded length;
    # of a longer text, used only where there is no other, the middle part is the landmark.
    size = F.octet_length("text")
    middle = F.when(size <= landmark_bytes, F.col("text")).otherwise(F.expr(f"substring(text, cast(greatest(1, (char_length(text) - {landmark_bytes // 4}) / 2) as int), {landmark_bytes // 4})"))
    ordered = rows.select("lang", middle.alias("text"), F.struct(F.when(size > landmark_bytes, 2).when(size >= 200, 0).otherwise(1).alias("s"), F.xxhash64(F.lit(seed + 1), "doc_id", "text").alias("h")).alias("o"))
    sets = [grams(t.lower().encode()) for _, t in sorted(_first_by(ordered, landmarks))]
    if not sets:
        sets = [np.zeros(0, np.uint64)]
    vocabulary = np.unique(np.concatenate(sets))
    presence = np.zeros((len(vocabulary), len(sets)), np.float32)
    for j, own in enumerate(sets):
        presence[np.searchsorted(vocabulary, own), j] = 1
    sizes = np.array([max(1, len(s)) for s in sets], float)
    between = (presence.T @ presence).astype(float) / np.sqrt(sizes[:, None] * sizes[None, :])
    value, vector = np.linalg.eigh(between)
    root = vector * (1 / np.sqrt(np.maximum(value, 1e-6)))
    model = Model(languages, vocabulary, np.packbits(presence.astype(bool), axis=1), sizes, root, np.zeros((len(sets) + 1, len(languages))))
    width = len(sets) + 1 + len(languages)
    # Each language weighs the same, however many rows it has.
    weight = {lang: sample / min(sample, n) for lang, n in counts.items()}

    def sums(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for part in parts:
            y = np.array([[1.0 if lang == x else -1.0 for x in languages] for lang in part.column(1).to_pylist()]).reshape(-1, len(languages))
            x = np.hstack([model.features(_lower(part.column(0))), np.ones((len(y), 1)), y])
            x *= np.sqrt([[weight[lang]] for lang in part.column(1).to_pylist()])
            total += x.T @ x
        yield pa.record_batch([pa.array([total.tobytes()], pa.binary())], ["sums"])

    # Each task sends one matrix of a fixed size; the sample is bounded, and so is the number of tasks that hold it.
    total = sum(np.frombuffer(bytes(r["sums"])).reshape(width, width) for r in streams(rows.select("text", "lang"), sums, "sums binary").toLocalIterator())
    n = len(sets) + 1
    model.weights = np.linalg.solve(total[:n, :n] + ridge * max(1.0, total[n - 1, n - 1]) * np.eye(n), total[:n, n:])
    return model


def _first_by(ordered: DataFrame, most: int) -> list[tuple[str, str]]:
    """(lang, text) of the first rows of each language; the sample is bounded, and Spark keeps only the first of each task."""
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("o"))
    return [(r["lang"], r["text"]) for r in ordered.withColumn("r", rank).where(F.col("r") <= most).collect()]


def identify(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, *keep, lang_pred, score), one row per input row; only the text decides.

    Null texts, texts without a letter and an empty model give ``und`` with score 0. The score is the winner's share
    of exp(3 * output). Of equal outputs the alphabetically first language wins. Repeated rows get equal results.
    """
    read = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.coalesce(F.col(text_col).cast("string").rlike(r"\p{L}"), F.lit(False)).alias("letter"), *[F.col(c).alias(f"keep_{i}") for i, c in enumerate(keep)])

    names = ["doc_id", *(f"keep_{i}" for i in range(len(keep)))]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            letter = np.array(part.column(2).to_pylist(), bool)
            lang = np.full(part.num_rows, UNKNOWN, object)
            score = np.zeros(part.num_rows)
            at = np.nonzero(letter)[0]
            if model is not None and len(at):
                out = model.scores(_lower(part.column(1).take(pa.array(at))))
                soft = np.exp(3 * (out - out.max(axis=1, keepdims=True)))
                lang[at] = np.array(model.languages, object)[out.argmax(axis=1)]
                score[at] = 1 / soft.sum(axis=1)
            yield pa.record_batch([part.column(0), *part.columns[3:], pa.array(lang.tolist(), pa.string()), pa.array(score)], [*names, "lang_pred", "score"])

    fields = ", ".join(f"{n} {read.schema[n].dataType.simpleString()}" for n in names)
    found = streams(read, run, f"{fields}, lang_pred string, score double")
    return found.select("doc_id", *[F.col(f"keep_{i}").alias(c) for i, c in enumerate(keep)], "lang_pred", "score")


def keep_recognised(docs: DataFrame, model: Model | None, least: float = LEAST_SCORE) -> DataFrame:
    """Documents whose language is recognised with a score of at least ``least``, with their own columns.

    Null and empty texts, texts without a letter, and texts unlike all learned languages go. Without a model those with a letter stay.
    """
    if model is None:
        return docs.where(F.coalesce(F.col("text"), F.lit("")).rlike(r"\p{L}"))
    own = {f"own_{i}": c for i, c in enumerate(docs.columns)}
    found = identify(docs.select("doc_id", "text", *[F.col(c).alias(k) for k, c in own.items()]), model, keep=tuple(own))
    return found.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least)).select(*[F.col(k).alias(c) for k, c in own.items()])


def training_rows(docs: DataFrame) -> DataFrame:
    """Documents whose crc32 of the id as text is not 2 modulo 4."""
    return docs.where(crc_share("doc_id", 4) != 2)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(training_rows(docs).select("doc_id", "text", "lang"))
    found = identify(docs.select("doc_id", "text", (crc_share("doc_id", 4) == 2).alias("held_out")), model, keep=("held_out",))
    return found.select("doc_id", "held_out", "lang_pred", "score")


QUERIES = {"op1_language_id": op1_language_id}
SQL: dict[str, str] = {}
