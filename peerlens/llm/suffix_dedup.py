"""Exact repeated substrings: every byte covered by a 200-byte string that starts in two places is removed.

Places are compared at anchors. An anchor of a 200-byte window is the first of its 32-byte strings with the smallest
hash; equal windows have their anchors at equal offsets, so two equal windows always meet at a pair of anchors with
the same 32 bytes (the anchor's key). For such a pair let l be the length of the common suffix of what stands before
the anchors and r that of the common prefix of what stands from them on: if l + r >= 200, all l + r bytes are repeated,
and the union over all pairs is exactly what must go. So each anchor needs the largest l and the largest r over
partners with l + r >= 200; what lies further away belongs to other anchors.

1. All anchors are sorted by (key, context hash, text) in one range shuffle of small rows; anchors whose key stands
   alone end there. A hot key spreads over several ranges; keys at the edges of ranges are counted by aggregates.
2. Anchors with equal contexts (all bytes that can matter) are repeated as a whole: counted, never compared. Of each group of equal contexts one stays as a partner for the others.
3. Different contexts under one key are suffix-sorted by deep-shallow sorting, the parts from the anchor on and,
   reversed, the parts before it: multikey quicksort to a shallow depth, then blind tries for groups with longer common
   prefixes. Common prefixes of neighbours give each anchor its partners from the nearest on.
   Keys with more than ``group`` different contexts take an exact way without a limit: their 200-byte windows are
   hashed and counted by Spark.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peerlens.llm.common import aside, batches, streams, table, text_bytes

LENGTH, KEY = 200, 32
#: More different contexts than this under one key are compared by window hashes.
GROUP = 32_768
#: Multikey quicksort compares this many bytes after the common start, blind tries the rest.
SHALLOW = 16
_PIECE = 1 << 18
_RUNS = "array<struct<start:bigint,end:bigint>>"
_PLACE_BITS = 20
_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def _mix(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    x = left * _M1 + (right ^ (right >> np.uint64(29))) * _M2
    return x ^ (x >> np.uint64(32))


def anchors(text: bytes, length: int = LENGTH, key: int = KEY) -> np.ndarray:
    """Anchor places of all windows, ascending. ``key`` is 8, 16, 32 or 64."""
    n = len(text) - length + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    width = length - key + 1
    words = np.ndarray((len(text) - 7,), "<u8", text, 0, (1,))
    found = []
    for at in range(0, n, _PIECE):
        m = min(_PIECE, n - at)
        h = words[at : at + m + width - 1 + key - 8].astype(np.uint64)
        span = 8
        h = _mix(h, h)
        while span < key:
            h = _mix(h[:-span], h[span:])
            span *= 2
        h *= _M3
        order = (h >> np.uint64(_PLACE_BITS) << np.uint64(_PLACE_BITS)) | np.arange(len(h), dtype=np.uint64)
        blocks = -(-len(order) // width)
        padded = np.full(blocks * width, np.iinfo(np.uint64).max)
        padded[: len(order)] = order
        grid = padded.reshape(blocks, width)
        ahead = np.minimum.accumulate(grid, axis=1).ravel()
        back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
        least = np.minimum(back[:m], ahead[width - 1 : width - 1 + m])
        place = (least & np.uint64((1 << _PLACE_BITS) - 1)).astype(np.int64)
        place = place[np.concatenate(([True], place[1:] != place[:-1]))] + at
        found.append(place[1:] if found and len(place) and place[0] == found[-1][-1] else place)
    return np.concatenate(found)


def sides(text: bytes, at: int, length: int = LENGTH, key: int = KEY) -> tuple[bytes, bytes]:
    """What can matter before an anchor, and from it on."""
    return text[max(0, at - (length - key)) : at], text[at : at + length]


# Deep-shallow sorting


def common(a: int, b: int, size: int) -> int:
    """Equal leading bytes of two strings of ``size`` bytes, given as big-endian numbers."""
    return size - ((a ^ b).bit_length() + 7) // 8


class _BlindTrie:
    """Orders strings with long common prefixes: nodes know only where strings part and by which byte.

    A string walks down blindly to some leaf, is compared with that leaf once, and then branches where they differ.
    """

    def __init__(self, strings: list[bytes], numbers: list[int], size: int):
        self.strings, self.numbers, self.size = strings, numbers, size
        self.root: list | int | None = None

    def insert(self, i: int) -> None:
        if self.root is None:
            self.root = i
            return
        s = self.strings[i]
        node = self.root
        while not isinstance(node, int):
            node = node[1].get(s[node[0]], next(iter(node[1].values())))
        depth = common(self.numbers[i], self.numbers[node], self.size)
        above, node = None, self.root
        while not isinstance(node, int) and node[0] < depth:
            above, node = (node, s[node[0]]), node[1][s[node[0]]]
        if not isinstance(node, int) and node[0] == depth:
            node[1][s[depth]] = i
            return
        leaf = node
        while not isinstance(leaf, int):
            leaf = next(iter(leaf[1].values()))
        branch = [depth, {self.strings[leaf][depth]: node, s[depth]: i}]
        if above is None:
            self.root = branch
        else:
            above[0][1][above[1]] = branch

    def walk(self) -> list[int]:
        out, stack = [], [self.root]
        while stack:
            node = stack.pop()
            if isinstance(node, int):
                out.append(node)
            else:
                stack.extend(node[1][c] for c in sorted(node[1], reverse=True))
        return out


def order(strings: list[bytes], size: int, start: int = 0, shallow: int = SHALLOW) -> list[int]:
    """Indices in ascending order of different strings of ``size`` bytes that agree in the first ``start``."""
    numbers = [int.from_bytes(s, "big") for s in strings]
    out: list[int] = []
    stack = [(list(range(len(strings))), start)]
    while stack:
        part, depth = stack.pop()
        if len(part) == 1:
            out.append(part[0])
        elif depth >= min(size, start + shallow):
            trie = _BlindTrie(strings, numbers, size)
            for i in part:
                trie.insert(i)
            out.extend(trie.walk())
        else:  # multikey quicksort: three ways by the byte at this depth
            pivot = strings[part[len(part) // 2]][depth]
            less = [i for i in part if strings[i][depth] < pivot]
            same = [i for i in part if strings[i][depth] == pivot]
            more = [i for i in part if strings[i][depth] > pivot]
            stack.extend(x for x in ((more, depth), (same, depth + 1), (less, depth)) if x[0])
    return out


def _sorted_side(parts: list[bytes], size: int, start: int) -> tuple[list[int], list[int]]:
    """Order of the strings with equal ones next to each other, and the common prefix of each with the next."""
    # Strings are padded; equal ones (the other side differs) are sorted once and put side by side.
    same: dict[bytes, list[int]] = {}
    for i, s in enumerate(parts):
        same.setdefault(s, []).append(i)
    plain = list(same)
    # Zero padding and a length byte pair keep different strings different.
    padded = [s + bytes(size - len(s)) + len(s).to_bytes(2, "big") for s in plain]
    ranked = order(padded, size + 2, min(start, min(map(len, plain), default=0)))
    out, near = [], []
    for k, i in enumerate(ranked):
        members = same[plain[i]]
        out += members
        near += [len(plain[i])] * (len(members) - 1)
        if k + 1 < len(ranked):
            j = ranked[k + 1]
            c = common(int.from_bytes(padded[i], "big"), int.from_bytes(padded[j], "big"), size + 2)
            near.append(min(c, len(plain[i]), len(plain[j])))
    return out, near


def extents(group: list[tuple[bytes, bytes]], want: list[bool], length: int = LENGTH, key: int = KEY) -> list[tuple[int, int]]:
    """For each wanted (before, after) of one key: the largest common suffix and prefix over partners with a sum of ``length`` or more, or (0, 0)."""
    befores = [b[::-1] for b, _ in group]
    afters = [a for _, a in group]
    size = {0: length - key, 1: length}
    numbers = [[int.from_bytes(s + bytes(n - len(s)), "big") for s in side] for side, n in ((befores, length - key), (afters, length))]
    sides_ = [befores, afters]
    best = [[0, 0] for _ in group]
    orders = {1: _sorted_side(sides_[1], size[1], key), 0: _sorted_side(sides_[0], size[0], 0)}
    # The longest that anyone shares with each member on either side: what no partner can exceed.
    most = {}
    for side, (ranked, near) in orders.items():
        most[side] = [0] * len(group)
        for at, i in enumerate(ranked):
            most[side][i] = max(near[at] if at < len(near) else 0, near[at - 1] if at else 0)
    for own, other in ((1, 0), (0, 1)):
        ranked, near = orders[own]
        for at, i in enumerate(ranked):
            if not want[i] or most[0][i] + most[1][i] < length:
                continue
            for step in (-1, 1):
                reach, j = size[own], at
                while True:
                    edge = j - 1 if step < 0 else j
                    j += step
                    if not 0 <= j < len(ranked):
                        break
                    reach = min(reach, near[edge])
                    if reach <= best[i][own] or reach + most[other][i] < length:
                        break
                    p = ranked[j]
                    c = min(common(numbers[other][i], numbers[other][p], size[other]), len(sides_[other][i]), len(sides_[other][p]))
                    if reach + c >= length:
                        best[i][own] = reach
                        best[i][other] = max(best[i][other], c)
                        break
    return [(b[0], b[1]) for b in best]


# Spark


def _signed(values: list[int]) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64))


def _anchor_rows(texts: DataFrame, length: int, key: int) -> DataFrame:
    """(key, context, text, at) of every anchor; ``text`` is the text's hash."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        k, c, t, a = [], [], [], []
        digest = xxhash.xxh3_64_intdigest
        for number, text in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1)), strict=True):
            for at in anchors(text, length, key).tolist():
                low = max(0, at - (length - key))
                k.append(digest(text[at : at + key]))
                c.append(digest(text[low : at + length], at - low))
                t.append(number)
                a.append(at)
        return pa.record_batch([_signed(k), _signed(c), pa.array(t, pa.int64()), pa.array(a, pa.int32())], ["key", "context", "text", "at"])

    return batches(texts, run, "key long, context long, text long, at int")


_MARK = "key long, context long, text long, at int, whole boolean, sent boolean, many boolean, edge boolean"


def _marks(rows: DataFrame, group: int) -> DataFrame:
    """Marks of the anchors whose key others share, from partitions sorted by (key, context, text, at).

    ``whole``: others have the same context; ``sent``: the first of its context under a key where contexts must be compared;
    ``many``: more than ``group`` contexts. The first and the last key of a partition may go on next door: their rows
    leave as they are, with ``edge`` set.
    """
    names = [f.split()[0] for f in _MARK.split(", ")]

    def judged(table: pa.Table, edge: bool) -> pa.RecordBatch:
        key, context = (table.column(i).to_numpy() for i in (0, 1))
        new_key = np.concatenate(([True], key[1:] != key[:-1]))
        new = new_key | np.concatenate(([True], context[1:] != context[:-1]))
        of, of_key = np.cumsum(new) - 1, np.cumsum(new_key) - 1
        n = np.bincount(of)
        whole = n[of] > 1
        kinds = np.bincount(of_key[new])[of_key]
        single = np.bincount(of_key[new], weights=n == 1)[of_key] > 0
        sent = new & (kinds > 1) & single
        keep = np.nonzero(np.full(len(key), edge) | whole | (kinds > 1))[0]
        flags = [pa.array(x[keep]) for x in (whole, sent, kinds > group, np.full(len(key), edge))]
        taken = table.take(pa.array(keep)).combine_chunks()
        columns = [c.chunk(0) if c.num_chunks else pa.array([], c.type) for c in taken.columns]
        return pa.record_batch([*columns, *flags], names)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # rows of the last key so far
        first = True
        for part in parts:
            key = part.column(0).to_numpy()
            if held and held[-1].column(0)[0].as_py() != key[0]:
                yield judged(pa.Table.from_batches(held), first)
                held, first = [], False
            starts = np.nonzero(key[1:] != key[:-1])[0] + 1
            if len(starts):
                # The first key of the part ends here, the last one may go on, those between are complete.
                held.append(part.slice(0, starts[0]))
                yield judged(pa.Table.from_batches(held), first)
                held, first = [], False
                if starts[-1] > starts[0]:
                    yield judged(pa.Table.from_batches([part.slice(starts[0], starts[-1] - starts[0])]), False)
                part = part.slice(starts[-1])
            held.append(part)
        if held:
            yield judged(pa.Table.from_batches(held), True)

    return streams(rows, run, _MARK)


def _edge_marks(edge: DataFrame, group: int) -> DataFrame:
    """The same marks for keys that lie on both sides of a partition's edge, a hot key among them: by aggregates."""
    equal = edge.groupBy("key", "context").agg(F.count("*").alias("n"), F.min(F.struct("text", "at")).alias("one"))
    keys = equal.groupBy("key").agg(F.count("*").alias("kinds"), F.sum(F.when(F.col("n") == 1, 1).otherwise(0)).alias("single"))
    contexts = equal.join(keys, "key").where("n > 1 OR kinds > 1")
    sent = F.expr("kinds > 1 AND single > 0") & (F.struct("text", "at") == F.col("one"))
    return edge.select("key", "context", "text", "at").join(contexts, ["key", "context"]).select("key", "context", "text", "at", (F.col("n") > 1).alias("whole"), sent.alias("sent"), (F.col("kinds") > group).alias("many"))


def repeats(texts: DataFrame, length: int = LENGTH, key: int = KEY, group: int = GROUP) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans), one row per input row; ``spans`` are the removed runs, byte places, end exclusive.

    Null texts count as empty; texts shorter than ``length`` have no run. Repeated rows are repeats of each other: each
    loses all that is ``length`` bytes or longer. Runs that touch count as one. Other columns are not read.
    """
    read = texts.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    docs = read.select("doc_id", F.xxhash64("text").alias("number"), F.xxhash64("doc_id").alias("row"), "text")
    long = docs.where(F.octet_length("text") >= length)
    n = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = _anchor_rows(long.select("number", "text"), length, key).repartitionByRange(n, "key", "context", "text", "at").sortWithinPartitions("key", "context", "text", "at")
    found = aside(_marks(rows, group), "repeat-anchors")
    marks = found.where("NOT edge").drop("edge").unionByName(_edge_marks(found.where("edge"), group))
    # Most marks are of whole contexts that nobody needs to see again: their place is enough.
    plain = F.expr("whole AND NOT sent")
    marks = marks.groupBy(F.col("text").alias("number")).agg(
        F.collect_set(F.when(plain, F.col("at"))).alias("wholes"), F.collect_set(F.when(~plain, F.struct("at", "key", "context", "whole", "sent", "many"))).alias("marks")
    )
    # Of equal texts one speaks for all.
    marks = marks.join(long.groupBy("number").agg(F.min("row").alias("speaker")), "number")
    marked = _packed(docs).join(marks, "number", "left").select(
        "doc_id", "number", "n_bytes", "sha", F.when(F.col("marks").isNotNull(), F.col("packed")).alias("packed"), "wholes", "marks", (F.col("row") == F.col("speaker")).alias("speaks")
    )
    marked = aside(marked, "repeat-texts")
    some = marked.where("marks IS NOT NULL")
    lone = F.exists("marks", lambda m: ~m["whole"])
    spans = _spans(some.where("speaks"), length, key)
    cut = some.where(lone).join(spans, "number", "left").select("doc_id", "packed", "wholes", "marks", "spans")
    cut = _cut(cut.unionByName(some.where(~lone).select("doc_id", "packed", "wholes", "marks"), allowMissingColumns=True), length, key)
    none = marked.where("marks IS NULL").select("doc_id", "n_bytes", F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.col("sha").alias("kept_sha256"), F.array().cast(_RUNS).alias("spans"))
    return cut.unionByName(none)


def _packed(docs: DataFrame) -> DataFrame:
    """Texts in compressed form, for the one shuffle that they take part in, with their length and digest."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = text_bytes(batch.column(3))
        pack = zstandard.ZstdCompressor(level=3).compress
        return pa.record_batch(
            [*batch.columns[:3], pa.array([len(t) for t in texts], pa.int64()), pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string()), pa.array([pack(t) for t in texts], pa.binary())],
            ["doc_id", "number", "row", "n_bytes", "sha", "packed"],
        )

    return batches(docs, run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, number long, row long, n_bytes long, sha string, packed binary")


def _unpacked(column: pa.Array) -> list[bytes]:
    unpack = zstandard.ZstdDecompressor().decompress
    return [unpack(x) for x in column.to_pylist()]


def _spans(some: DataFrame, length: int, key: int) -> DataFrame:
    """(number, spans): extents of the anchors whose contexts stand alone but share a key with others."""

    def send(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: list[tuple] = []
        for text, marks in zip(_unpacked(batch.column(0)), batch.column(1).to_pylist(), strict=True):
            for m in marks:
                if m["sent"]:
                    out.append((m["key"], m["context"], not m["whole"], m["many"], *sides(text, m["at"], length, key)))
        columns = list(zip(*out, strict=True)) or [()] * 6
        kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.binary(), pa.binary())
        return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["key", "context", "want", "many", "before", "after"])

    sent = batches(some.select("packed", "marks").where(F.exists("marks", lambda m: m["sent"])), send, "key long, context long, want boolean, many boolean, before binary, after binary")
    n = int(some.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    few = sent.where("NOT many").repartition(n, "key").sortWithinPartitions("key", "context")

    def compare(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def solve() -> list[tuple]:
            got = extents([(b, a) for _, _, _, b, a in held], [w for _, _, w, _, _ in held], length, key)
            return [(k, c, left, right) for (k, c, w, _, _), (left, right) in zip(held, got, strict=True) if w and left + right >= length]

        done: list[tuple] = []
        for part in parts:
            for row in zip(*(part.column(i).to_pylist() for i in (0, 1, 2, 4, 5)), strict=True):
                if held and held[0][0] != row[0]:
                    done += solve()
                    held = []
                if not held or held[-1][1] != row[1]:  # rows of one id may send a context twice
                    held.append(row)
            yield _extent_rows(done)
            done = []
        if held:
            yield _extent_rows(solve())

    small = streams(few, compare, "key long, context long, left int, right int")

    def windows(batch: pa.RecordBatch) -> pa.RecordBatch:
        w, k, c, o = [], [], [], []
        for kk, cc, b, a in zip(*(batch.column(i).to_pylist() for i in (0, 1, 4, 5)), strict=True):
            text = b + a
            for p in range(len(text) - length + 1):
                w.append(xxhash.xxh3_128_digest(text[p : p + length]))
                k.append(kk)
                c.append(cc)
                o.append(len(b) - p)
        return pa.record_batch([pa.array(w, pa.binary()), pa.array(k, pa.int64()), pa.array(c, pa.int64()), pa.array(o, pa.int32())], ["window", "key", "context", "before"])

    # Windows that do not hold the whole key (before < 0 never happens: they start at the anchor or earlier).
    all_windows = batches(sent.where("many").dropDuplicates(["key", "context"]), windows, "window binary, key long, context long, before int").where("before >= 0")
    twice = all_windows.groupBy("key", "window", "before").agg(F.count("*").alias("n")).where("n > 1").select("key", "window", "before")
    large = all_windows.join(twice, ["key", "window", "before"]).groupBy("key", "context").agg(F.max("before").alias("left"), (length - F.min("before")).cast("int").alias("right"))
    extent = small.unionByName(large)
    lone = some.select("number", F.explode(F.filter("marks", lambda m: ~m["whole"])).alias("m")).select("number", "m.at", "m.key", "m.context").distinct()
    return lone.join(extent, ["key", "context"]).groupBy("number").agg(F.collect_list(F.struct("at", "left", "right")).alias("spans"))


def _extent_rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * 4
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
    return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["key", "context", "left", "right"])


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of the union; runs that touch are one."""
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def _cut(some: DataFrame, length: int, key: int) -> DataFrame:
    kind = some.schema["doc_id"].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for text, wholes, marks, extra in zip(_unpacked(batch.column(1)), *(batch.column(i).to_pylist() for i in (2, 3, 4)), strict=True):
            places = [*wholes, *(m["at"] for m in marks if m["whole"])]
            spans = [(max(0, at - (length - key)), min(len(text), at + length)) for at in places]
            spans += [(x["at"] - x["left"], x["at"] + x["right"]) for x in extra or ()]
            runs = merged(spans)
            kept, at = hashlib.sha256(), 0
            for s, e in runs:
                kept.update(text[at:s])
                at = e
            kept.update(text[at:])
            rows.append((len(text), sum(e - s for s, e in runs), len(runs), kept.hexdigest(), [{"start": s, "end": e} for s, e in runs]))
        columns = list(zip(*rows, strict=True)) or [()] * 5
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
        return pa.record_batch([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])

    return batches(some, run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans {_RUNS}")


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats(table(spark, sf_dir, "documents")).drop("spans")


QUERIES = {"op5_suffix_dedup": op5_suffix_dedup}
SQL: dict[str, str] = {}
