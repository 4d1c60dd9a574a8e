"""Benchmark decontamination by the q-gram lemma.

Texts and benchmark items are brought to one form: lower-cased ASCII, everything but letters and digits a space,
spaces collapsed. Every window of m bytes of an item is looked for, at every place; a shorter item is one window. A
text region within ``e`` edits of a window shares at least m + 1 - q (e + 1) of the window's q-grams with it, all on
diagonals (place in the text minus place in the item) that differ by at most e from each other. So the item's q-grams
found in the text are counted in diagonal bands that overlap by half, windows that reach the bound inside a band are
candidates, and a banded alignment of the window inside the band's region decides.

Items are indexed in parts that overlap by a window less one byte, so that each window lies in one part.

The benchmark is read in blocks of bounded size, each with its own pass over the texts; the given tables need one.
A text is seen by one task from its words to its verdict; nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peerlens.llm.common import streams, table, text_bytes

#: q = 8 bytes fill one 64-bit number, so q-grams are compared exactly.
Q = 8
#: Bytes of a window, and of an indexed part of an item; shorter items are one window.
WINDOW, PART = 120, 480
#: Edits allowed per window byte, and the shortest item that can witness a leak.
EDIT_RATE, MIN_CHARS = 0.1, 40
#: Benchmark bytes in one pass.
BLOCK_BYTES = 8 << 20
_FILTER_BITS = 20
#: Long texts are searched in overlapping pieces, halved while a piece has more q-gram hits than this.
_PIECE, _HITS = 1 << 12, 1 << 22
_WIDE = 128

_PLAIN = bytes(c if chr(c).isalnum() or c >= 128 else 32 for c in bytes(range(256)).lower())


def plain(text: bytes) -> bytes:
    return b" ".join(text.translate(_PLAIN).split())


def edits(length: int, rate: float = EDIT_RATE) -> int:
    return int(length * rate)


def threshold(length: int, rate: float = EDIT_RATE) -> int:
    """Shared q-grams that a region within the budget must have."""
    return length + 1 - Q * (edits(length, rate) + 1)


def cut(item: bytes, window: int = WINDOW, part: int = PART) -> list[bytes]:
    """Parts of the item, such that each window of it lies whole in one of them."""
    return [item[s : s + part] for s in range(0, max(1, len(item) - window + 1), part - window + 1)]


def best_inside(segment: bytes, region: bytes, low: int, high: int) -> int:
    """Fewest edits that turn the segment into some part of the region, over diagonals low..high (region place minus segment place).

    One row of the alignment per segment byte; each row is a vector over the diagonals, so the work is length x band.
    Places outside the region hold a byte that matches nothing: pairing with it costs as much as leaving a byte out.
    """
    width = high - low + 1
    text = np.full(max(high + len(segment), len(region)) - min(low, 0) + 1, -1, np.int16)
    text[max(0, -low) : max(0, -low) + len(region)] = np.frombuffer(region, np.uint8)
    text = text[max(0, low) :]
    across = np.arange(width)
    row = np.zeros(width, np.int64)
    for i, byte in enumerate(segment):
        step = row + (text[i : i + width] != byte)
        np.minimum(step[:-1], row[1:] + 1, out=step[:-1])  # leave a segment byte out: from the next diagonal
        # Extra region bytes move one diagonal up each: a running minimum of (value - place) + place.
        row = np.minimum.accumulate(step - across) + across
    return int(row.min())


def any_inside(part: bytes, starts: np.ndarray, length: int, region: bytes, low: int, high: int) -> np.ndarray:
    """``best_inside`` of the windows of the part at all the starts at once, over diagonals low..high (region place minus part place)."""
    width = high - low + 1
    reach = int(starts[-1]) + length + width
    text = np.full(max(reach, len(region) - low), -1, np.int16)
    text[max(0, -low) : max(0, len(region) - low)] = np.frombuffer(region, np.uint8)[max(0, low) :]
    rows = np.lib.stride_tricks.sliding_window_view(text, width)
    own = np.frombuffer(part, np.uint8)
    across = np.arange(width)
    row = np.zeros((len(starts), width), np.int64)
    for i in range(length):
        step = row + (rows[starts + i] != own[starts + i, None])
        np.minimum(step[:, :-1], row[:, 1:] + 1, out=step[:, :-1])
        row = np.minimum.accumulate(step - across, axis=1) + across
    return row.min(axis=1)


class Block:
    """Index of the q-grams of some benchmark items."""

    def __init__(self, items: list[tuple[int, bytes]], rate: float, min_chars: int):
        self.rate = rate
        self.parts: list[tuple[int, bytes]] = [(i, s) for i, text in items if len(text) >= min_chars for s in cut(text)]
        grams, owner, place = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for k, (_, s) in enumerate(self.parts):
            g = qgrams(s)
            grams.append(g)
            owner.append(np.full(len(g), k))
            place.append(np.arange(len(g)))
        grams, owner, place = np.concatenate(grams), np.concatenate(owner), np.concatenate(place)
        order = np.lexsort((place, owner, grams))
        self.grams, self.owner, self.place = grams[order], owner[order], place[order]
        self.distinct, self.first, self.times = np.unique(self.grams, return_index=True, return_counts=True)
        self.maybe = np.zeros(1 << _FILTER_BITS, bool)
        self.maybe[_slot(self.distinct)] = True
        self.window = np.array([min(len(s), WINDOW) for _, s in self.parts], np.int64)
        self.need = np.array([max(1, threshold(m, rate)) for m in self.window.tolist()], np.int64)
        self.budget = np.array([edits(m, rate) for m in self.window.tolist()], np.int64)

    def matches(self, text: bytes) -> dict[int, int]:
        """Item -> edits, for each item of which a window lies in the plain text; the edits are those of the first region found."""
        found: dict[int, int] = {}
        own = qgrams(text)
        overlap = 2 * WINDOW
        pieces = [(at, min(len(own), at + _PIECE + overlap)) for at in range(0, len(own), _PIECE)]
        while pieces:
            start, end = pieces.pop(0)
            at = start + np.nonzero(self.maybe[_slot(own[start:end])])[0]
            if not len(self.need) or len(at) < self.need.min():
                continue
            where = np.searchsorted(self.distinct, own[at])
            where[where == len(self.distinct)] = 0
            same = self.distinct[where] == own[at]
            at, where = at[same], where[same]
            n = self.times[where]
            if n.sum() > _HITS and end - start > 2 * overlap:
                half = (start + end - overlap) // 2
                pieces = [(start, half + overlap), (half, end), *pieces]
            elif n.sum():
                self._verify(text, at, where, n, found)
        return found

    def _verify(self, text: bytes, at: np.ndarray, where: np.ndarray, n: np.ndarray, found: dict[int, int]) -> None:
        # All (text place, part, diagonal) hits; a text q-gram meets each of its places in the parts once.
        slot = np.repeat(self.first[where] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        owner = self.owner[slot]
        diagonal = np.repeat(at, n) - self.place[slot]
        # First a rough count in wide bands, several to a counter: what is below the bound there is below it in each band.
        kept = np.zeros(len(owner), bool)
        for shift in (0, _WIDE // 2):
            counter = (owner * 40_503 + (diagonal + PART + shift) // _WIDE) & 8191
            kept |= np.bincount(counter, minlength=8192)[counter] >= self.need[owner]
        if not kept.any():
            return
        owner, place, diagonal = owner[kept], self.place[slot[kept]], diagonal[kept]
        # Bands of 2e + 2 diagonals in two layers, half a band apart: any e + 1 neighbours lie inside one of them.
        width = 2 * self.budget[owner] + 2
        regions = []
        for layer in (0, 1):
            band = (diagonal + PART + layer * (width // 2)) // width
            # A q-gram place of the part counts once in a band, however often the text has it.
            once = np.unique((owner * (1 << 32) + band) * PART + place)
            key, own = once // PART, once % PART
            mine = key >> 32
            # A window reaches the bound if so many places of one band lie within its q-grams.
            last = np.arange(len(once)) + self.need[mine] - 1
            inside = np.nonzero(last < len(once))[0]
            last = last[inside]
            full = inside[(key[last] == key[inside]) & (own[last] - own[inside] <= self.window[mine[inside]] - Q)]
            for k in np.unique(key[full]).tolist():
                o = k >> 32
                w = 2 * int(self.budget[o]) + 2
                a, b = np.searchsorted(key, [k, k + 1])
                regions.append(((k % (1 << 32)) * w - PART - layer * (w // 2), w, o, own[a:b]))
        for low, w, o, places in sorted(regions, key=lambda x: x[:3]):
            item, part = self.parts[o]
            if item in found:
                continue
            m, budget = int(self.window[o]), int(self.budget[o])
            starts = np.arange(len(part) - m + 1)
            count = np.searchsorted(places, starts + m - Q, "right") - np.searchsorted(places, starts)
            starts, count = starts[count >= self.need[o]], count[count >= self.need[o]]
            high = low + w - 1
            # Alignments may drift by the budget from the band in which their q-grams were counted.
            s, e = max(0, low + int(starts[0]) - budget), min(len(text), high + int(starts[-1]) + m + budget + 1)
            region = text[s:e]
            # The window that shares most first: of a copy it is nearly always within the budget.
            best = int(starts[count.argmax()])
            window = part[best : best + m]
            d = 0 if window in region else best_inside(window, region, low + best - budget - s, high + best + budget - s)
            if d > budget and len(starts) > 1:
                d = int(any_inside(part, starts, m, region, low - budget - s, high + budget - s).min())
            if d <= budget:
                found[item] = d


def qgrams(text: bytes) -> np.ndarray:
    if len(text) < Q:
        return np.zeros(0, np.uint64)
    return np.ndarray((len(text) - Q + 1,), "<u8", text, 0, (1,)).copy()


def _slot(keys: np.ndarray) -> np.ndarray:
    return (keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _FILTER_BITS)


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, block_bytes: int) -> Iterator[list[tuple[int, bytes]]]:
    held, size = [], 0
    rows = benchmark.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    for item, text in rows.toLocalIterator():
        done = plain(text.encode())
        held.append((item, done))
        size += len(done)
        if size >= block_bytes:
            yield held
            held, size = [], 0
    yield held


def contamination(docs: DataFrame, benchmark: DataFrame, rate: float = EDIT_RATE, min_chars: int = MIN_CHARS, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, contaminated, n_items, item_ids, min_edits), then the input's columns, one row per input row.

    ``item_ids``: the matched items, ascending, comma-joined (empty if none); ``min_edits``: the fewest edits among the
    first regions found for them, null if none. Null and empty texts are clean. Items' ids are whole numbers. Benchmark rows with a null id or text, or with fewer than
    ``min_chars`` plain characters, say too little to prove a leak and match nothing; of an item of more than 120, each
    passage of 120 is looked for. Repeated documents are judged
    each, repeated items count once. Own columns of these names are replaced.
    """
    own = ("contaminated", "n_items", "item_ids", "min_edits")
    if threshold(min_chars, rate) < 1 or threshold(WINDOW, rate) < 1:
        raise ValueError("the edit rate leaves no shared q-gram to find a region by")
    mark = "_found"
    while mark in docs.columns:
        mark += "_"
    out = docs.drop(*own).withColumn(mark, F.lit(None).cast("array<struct<item:bigint,edits:int>>"))
    for items in _blocks(benchmark, "item_id", "text", block_bytes):
        block = Block(items, rate, min_chars)
        names = out.columns

        def run(parts: Iterator[pa.RecordBatch], block: Block = block, names: list[str] = names) -> Iterator[pa.RecordBatch]:
            for part in parts:
                texts = text_bytes(part.column(names.index(text_col)))
                found = [[*(old or []), *({"item": i, "edits": d} for i, d in block.matches(plain(t)).items())] for t, old in zip(texts, part.column(len(names) - 1).to_pylist(), strict=True)]
                yield pa.record_batch([*part.columns[:-1], pa.array(found, pa.list_(pa.struct([("item", pa.int64()), ("edits", pa.int32())])))], names)

        out = streams(out, run, out.schema)
    items = F.array_sort(F.array_distinct(F.transform(mark, lambda x: x["item"])))
    return out.select(
        F.col(id_col),
        (F.size(mark) > 0).alias("contaminated"),
        F.size(items).alias("n_items"),
        F.array_join(F.transform(items, lambda x: x.cast("string")), ",").alias("item_ids"),
        F.array_min(F.transform(mark, lambda x: x["edits"])).alias("min_edits"),
        *[c for c in docs.columns if c not in own and c != id_col],
    )


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Documents without a benchmark passage, whole and with their own columns."""
    return contamination(docs, benchmark).where("NOT contaminated").select(*docs.columns)


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.drop("text")


QUERIES = {"op8_benchmark_decontamination": op8_benchmark_decontamination}
SQL: dict[str, str] = {}
