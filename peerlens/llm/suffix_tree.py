"""Language-model scores from a probabilistic suffix tree over bytes, beside a word unigram baseline.

Tree: a context is the last 1 to ``depth`` bytes. It is kept if it is frequent (at least ``min_share`` of all training
symbols, so that each depth has at most 1 / min_share contexts and the model's size has a bound that does not grow
with the corpus) and if the next-symbol distribution diverges from that of the context one byte shorter; the suffixes
of a kept context are kept. Distributions are smoothed towards the shorter context, down to the uniform one, and sum
to one over the 256 bytes and the end. A text is scored in its longest kept contexts by an automaton whose states are
the beginnings of kept contexts.

Counting: each task sorts the packed (context, symbol) numbers of its texts; Spark adds them up, and the frequent rows
go to the driver. Baseline: each chunk of some megabytes of text keeps its own word list; word counts travel once per
(chunk, word), never once per document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from peerlens.llm.common import aside, crc_share, streams, table, text_bytes

DEPTH = 5
MIN_SHARE = 1e-5
#: A context is kept if its divergence is at least this (nats per symbol) and more than chance would give.
MIN_DIVERGENCE = 0.01
#: Text bytes per chunk, and positions counted at once.
CHUNK_BYTES, COUNT_AT_ONCE = 8 << 20, 1 << 21
END = 256
_SEGMENT = 192


def lowered(column: pa.Array) -> list[bytes]:
    return [t.lower() for t in text_bytes(column)]


def packed(texts: list[bytes], depth: int = DEPTH) -> np.ndarray:
    """context << 9 | symbol of every symbol of every text, its end included; before a text stand zero bytes.

    The context's lowest byte is the latest one, so shorter contexts are the low bytes of longer ones.
    """
    pad = bytes(depth)
    joined = np.frombuffer(b"".join(x for t in texts for x in (pad, t, b"\0")), np.uint8).astype(np.uint64)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    stops = np.cumsum(lengths + depth + 1) - 1
    symbol = joined.copy()
    symbol[stops] = END
    context = np.zeros(len(joined), np.uint64)
    for j in range(1, depth + 1):
        context[j:] |= joined[:-j] << np.uint64(8 * (j - 1))
    keep = np.ones(len(joined), bool)
    begins = stops - lengths - depth
    for j in range(depth):
        keep[begins + j] = False
    return (context << np.uint64(9) | symbol)[keep]


def _tally(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, with their counts."""
    if counts is None:
        keys = np.sort(keys)
    else:
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
    first = np.nonzero(np.concatenate(([True], keys[1:] != keys[:-1])))[0] if len(keys) else np.zeros(0, np.int64)
    if counts is None:
        return keys[first], np.diff(np.append(first, len(keys)))
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def symbol_counts(train: DataFrame, depth: int = DEPTH, text_col: str = "text") -> DataFrame:
    """(context, symbol, n) of the longest contexts over all training texts."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        held: list[bytes] = []
        size = 0

        def add() -> None:
            nonlocal keys, counts, held, size
            k, c = _tally(packed(held, depth))
            keys, counts = _tally(np.concatenate((keys, k)), np.concatenate((counts, c)))
            held, size = [], 0

        for part in parts:
            for text in lowered(part.column(0)):
                # Long texts are cut with their context: a piece is counted as if the bytes before it were its start.
                if len(text) > COUNT_AT_ONCE:
                    for k, c in _pieces(text, depth):
                        keys, counts = _tally(np.concatenate((keys, k)), np.concatenate((counts, c)))
                    continue
                held.append(text)
                size += len(text) + depth + 1
                if size >= COUNT_AT_ONCE:
                    add()
            if len(keys) > 4 * COUNT_AT_ONCE:  # memory stays bounded; Spark adds the parts up
                yield _rows(keys, counts)
                keys, counts = keys[:0], counts[:0]
        if held:
            add()
        yield _rows(keys, counts)

    def _rows(keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        return pa.record_batch([pa.array(keys.astype(np.int64)), pa.array(counts)], ["key", "n"])

    counted = streams(train.select(F.col(text_col).cast("string").alias("text")), run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    return counted.select(F.shiftright("key", 9).alias("context"), F.col("key").bitwiseAND(F.lit(511)).cast("int").alias("symbol"), "n")


def _pieces(text: bytes, depth: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for at in range(0, len(text), COUNT_AT_ONCE):
        piece = text[max(0, at - depth) : at + COUNT_AT_ONCE]
        keys = packed([piece], depth)
        last = at + COUNT_AT_ONCE >= len(text)
        yield _tally(keys[min(at, depth) : len(keys) if last else -1])


@dataclass
class Tree:
    """The automaton: ``step[state, class]``, ``out[state]`` the distribution used there, ``logp[distribution, class]`` in log10."""

    classes: np.ndarray
    step: np.ndarray
    out: np.ndarray
    logp: np.ndarray
    depth: int
    contexts: int

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """log10 probability of each text and its end."""
        depth, none = self.depth, self.logp.shape[1] - 1
        end = none - 1
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        n = -(-(lengths + 1) // _SEGMENT)
        owner = np.repeat(np.arange(len(texts)), n)
        place = (np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)) * _SEGMENT
        padded = b"".join(x for t in texts for x in (bytes(depth), t, b"\0")) + bytes(_SEGMENT + depth)
        classes = self.classes[np.frombuffer(padded, np.uint8)]
        starts = np.cumsum(lengths + depth + 1) - (lengths + depth + 1)
        classes[starts + lengths + depth] = end
        first = starts[owner] + place
        left = lengths[owner] + 1 - place
        state = np.zeros(len(owner), np.int64)
        total = np.zeros(len(owner))
        width = self.step.shape[1]
        step, logp = self.step.ravel(), self.logp.ravel()
        for t in range(depth + _SEGMENT):
            now = classes[first + t]
            if t >= depth:
                now = np.where(t - depth < left, now, none)
                total += logp[self.out[state] * width + now]
            state = step[state * width + now]
        return np.bincount(owner, weights=total, minlength=len(texts))


def grow(counts: dict[int, dict[int, np.ndarray]], total: np.ndarray, depth: int = DEPTH, min_divergence: float = MIN_DIVERGENCE) -> Tree:
    """Tree from ``counts[d][context]``, the symbol counts (257) of the frequent contexts of each depth, and those of all symbols."""
    seen = np.nonzero(total[:END] > 0)[0]
    smooth = {(0, 0): (total + 1.0 / 257) / (total.sum() + 1)}
    keep = {(0, 0)}
    for d in range(1, depth + 1):
        for context, own in counts.get(d, {}).items():
            parent = smooth.get((d - 1, context & ((1 << 8 * (d - 1)) - 1)))
            if parent is None:
                continue
            n, kinds = own.sum(), np.count_nonzero(own)
            smooth[d, context] = (own + kinds * parent) / (n + kinds)
            p = own[own > 0] / n
            divergence = float((p * np.log(p / parent[own > 0])).sum())
            if divergence >= min_divergence and 2 * n * divergence > kinds + 4 * np.sqrt(2 * kinds):
                keep.update((k, context & ((1 << 8 * k) - 1)) for k in range(1, d + 1))
    # Symbol classes: the bytes seen in training and the padding byte, all other bytes, the end, nothing.
    known = np.union1d(seen, [0])
    classes = np.full(256, len(known), np.int64)
    classes[known] = np.arange(len(known))
    width = len(known) + 3
    kept = sorted(keep)
    logp = np.zeros((len(kept), width))
    other = next((b for b in range(END) if b not in set(known.tolist())), None)
    for i, key in enumerate(kept):
        logp[i, : len(known)] = np.log10(smooth[key][known])
        logp[i, len(known)] = np.log10(smooth[key][other]) if other is not None else 0.0
        logp[i, len(known) + 1] = np.log10(smooth[key][END])
    # Automaton over the kept contexts in reading order (oldest byte first).
    spelled = {bytes(c >> 8 * j & 255 for j in reversed(range(d))): i for i, (d, c) in enumerate(kept)}
    nodes = sorted({s[:k] for s in spelled for k in range(len(s) + 1)} | {b""}, key=lambda s: (len(s), s))
    number = {s: i for i, s in enumerate(nodes)}
    step = np.zeros((len(nodes), width), np.int32)
    out = np.zeros(len(nodes), np.int64)
    children: dict[int, list[tuple[int, int]]] = {}
    for s in nodes[1:]:
        children.setdefault(number[s[:-1]], []).append((int(classes[s[-1]]), number[s]))
    for i, s in enumerate(nodes):
        fall = next(number[s[k:]] for k in range(1, len(s) + 1) if s[k:] in number) if s else 0
        if s:
            step[i] = step[fall]
            out[i] = spelled.get(s, out[fall])
        else:
            out[i] = spelled[b""]
        for c, child in children.get(i, ()):
            step[i, c] = child
    step[:, len(known) :] = 0
    return Tree(classes, step, out, logp, depth, len(kept))


def fit(train: DataFrame, depth: int = DEPTH, min_share: float = MIN_SHARE, min_divergence: float = MIN_DIVERGENCE, text_col: str = "text") -> Tree:
    """Tree of the training texts; every text counts whole. Without any text the model is the uniform distribution."""
    deepest = aside(symbol_counts(train, depth, text_col), "pst-counts")
    all_symbols = np.zeros(257)
    for symbol, n in deepest.groupBy("symbol").agg(F.sum("n")).collect():
        all_symbols[symbol] = n
    least = max(2.0, min_share * all_symbols.sum())
    counts: dict[int, dict[int, np.ndarray]] = {}
    level = deepest
    for d in range(depth, 0, -1):
        if d < depth:
            level = level.groupBy(F.col("context").bitwiseAND(F.lit((1 << 8 * d) - 1)).alias("context"), "symbol").agg(F.sum("n").alias("n"))
        often = level.groupBy("context").agg(F.sum("n").alias("all")).where(F.col("all") >= least).select("context")
        # At most 1 / min_share contexts with up to 257 symbols each.
        rows = level.join(often, "context").toPandas()
        order = np.argsort(rows["context"].to_numpy(), kind="stable")
        context, symbol, n = (rows[c].to_numpy()[order] for c in ("context", "symbol", "n"))
        counts[d] = {}
        edges = np.append(np.nonzero(np.concatenate(([True], context[1:] != context[:-1])))[0], len(context)) if len(context) else [0]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            own = np.zeros(257)
            own[symbol[a:b]] = n[a:b]
            counts[d][int(context[a])] = own
    return grow(counts, all_symbols, depth, min_divergence)


_CHUNK_DDL = "chunk long, word binary, place int, n long, ids array<struct<doc:string,held_out:boolean,tokens:long,ends:long,score:double>>, pairs binary"


def _chunks(docs: DataFrame, tree: Tree) -> DataFrame:
    """For each chunk one row per distinct word (word, place, training count) and one row with its documents.

    ``pairs`` holds the compressed numbers of the documents' distinct words, the steps between their places, and
    their counts.
    """

    class Chunk:
        def __init__(self) -> None:
            self.place: dict[bytes, int] = {}
            self.train: list[int] = []
            self.ids: list[dict] = []
            self.steps: list[np.ndarray] = []
            self.counts: list[np.ndarray] = []
            self.size = 0

        def add(self, doc: str | None, held_out: bool, text: bytes, score: float) -> None:
            own: dict[int, int] = {}
            n = 0
            for w in text.split():
                n += 1
                at = self.place.setdefault(w, len(self.place))
                own[at] = own.get(at, 0) + 1
            self.train.extend([0] * (len(self.place) - len(self.train)))
            if not held_out:
                for at, k in own.items():
                    self.train[at] += k
            places = sorted(own)
            self.steps.append(np.diff(np.array(places, "<u4"), prepend=np.uint32(0)).astype("<u4"))
            self.counts.append(np.array([own[at] for at in places], "<u4"))
            self.ids.append({"doc": doc, "held_out": held_out, "tokens": n + 1, "ends": 0 if held_out else 1, "score": score})
            self.size += len(text) + 64

        def rows(self, number: int) -> Iterator[pa.RecordBatch]:
            kinds = dict(zip(("chunk", "word", "place", "n", "ids", "pairs"), (pa.int64(), pa.binary(), pa.int32(), pa.int64(), _IDS, pa.binary()), strict=True))
            make = lambda columns: pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds.values(), strict=True)], list(kinds))
            words = list(self.place)
            for at in range(0, len(words), 1 << 14):
                part = words[at : at + (1 << 14)]
                nulls = [None] * len(part)
                yield make([[number] * len(part), part, range(at, at + len(part)), self.train[at : at + len(part)], nulls, nulls])
            sizes = np.fromiter(map(len, self.steps), "<u4", len(self.steps))
            pairs = zstandard.ZstdCompressor(level=1).compress(np.concatenate([sizes, *self.steps, *self.counts]).tobytes())
            yield make([[number], [None], [None], [None], [self.ids], [pairs]])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        chunk = Chunk()
        for part in parts:
            texts = lowered(part.column(1))
            scores = tree.scores(texts).tolist() if texts else []
            for doc, text, held_out, score in zip(part.column(0).to_pylist(), texts, part.column(2).to_pylist(), scores, strict=True):
                chunk.add(doc, held_out, text, score)
                if chunk.size >= CHUNK_BYTES:
                    yield from chunk.rows(number)
                    number, chunk = number + 1, Chunk()
        if chunk.ids:
            yield from chunk.rows(number)

    return streams(docs, run, _CHUNK_DDL)


_IDS = pa.list_(pa.struct([("doc", pa.string()), ("held_out", pa.bool_()), ("tokens", pa.int64()), ("ends", pa.int64()), ("score", pa.float64())]))


def score(docs: DataFrame, held_out: F.Column, depth: int = DEPTH, min_share: float = MIN_SHARE, min_divergence: float = MIN_DIVERGENCE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), one row per input row.

    Learns from the rows where ``held_out`` is false. Null texts count as empty: one token, the end. Repeated rows
    each count and each get a row. Without training rows every token has the same baseline probability and every byte
    the same model probability. Other columns are not read.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    read = docs.select(F.col(id_col).cast("string").alias("doc"), F.col(text_col).cast("string").alias("text"), held_out.alias("held_out"))
    tree = fit(read.where(~F.col("held_out")), depth, min_share, min_divergence)
    chunks = aside(_chunks(read, tree), "lm-chunks")
    words = chunks.where("word IS NOT NULL").select("word", "chunk", "place", "n")
    same = Window.partitionBy("word")
    counted = words.select("chunk", "place", "n", F.sum("n").over(same).alias("c"), F.row_number().over(same.orderBy("chunk")).alias("r"))
    counted = aside(counted, "lm-words")
    n_words, distinct = counted.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.when((F.col("r") == 1) & (F.col("c") > 0), 1)), F.lit(0))).first()
    lists = chunks.where("ids IS NOT NULL").select("chunk", "ids", "pairs")
    ends = lists.select(F.aggregate("ids", F.lit(0).cast("long"), lambda a, x: a + x["ends"]).alias("e")).agg(F.coalesce(F.sum("e"), F.lit(0))).first()[0]
    total, kinds = n_words + ends, distinct + (1 if ends else 0)
    below = np.log10(total + 0.1 * (kinds + 1))
    known = counted.groupBy("chunk").agg(F.collect_list(F.struct("place", "c")).alias("counts"))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for i in range(part.num_rows):
                ids = part.column(0)[i].as_py()
                pairs = np.frombuffer(zstandard.ZstdDecompressor().decompress(part.column(1)[i].as_py()), "<u4").astype(np.int64)
                counts = part.column(2)[i].values
                c = np.zeros(0 if counts is None else len(counts), np.int64)
                if counts is not None:
                    c[counts.field("place").to_numpy()] = counts.field("c").to_numpy()
                logs = np.log10(c + 0.1) - below
                end = np.log10(ends + 0.1) - below
                sizes = pairs[: len(ids)]
                steps, times = np.split(pairs[len(ids) :], 2)
                owner = np.repeat(np.arange(len(ids)), sizes)
                # Places are running sums that start anew with each document.
                upto = np.cumsum(steps)
                before = np.concatenate(([0], upto))[np.cumsum(sizes) - sizes]
                place = upto - before[owner]
                base = np.bincount(owner, weights=logs[place] * times, minlength=len(ids)) + end
                found = np.bincount(owner, weights=np.where(c[place] > 0, times, 0), minlength=len(ids)).astype(np.int64) + (1 if ends else 0)
                columns = [[x[f] for x in ids] for f in ("doc", "held_out", "tokens", "score")]
                yield pa.record_batch(
                    [pa.array(columns[0], pa.string()), pa.array(columns[1], pa.bool_()), pa.array(columns[2], pa.int64()), pa.array(found), pa.array([total] * len(ids), pa.int64()), pa.array(base), pa.array(columns[3], pa.float64())],
                    ["doc", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    joined = lists.join(known, "chunk", "left").select("ids", "pairs", "counts")
    out = streams(joined, run, "doc string, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return out.select(F.col("doc").cast(kind).alias("doc_id"), "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, crc_share("doc_id", 10) == 0)


QUERIES = {"op4_lm_scoring": op4_lm_scoring}
SQL: dict[str, str] = {}
