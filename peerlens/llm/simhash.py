"""SimHash near-duplicates: 64-bit fingerprints, pigeonhole blocks, exact Hamming links, connected groups.

Work follows distinct fingerprints, not documents: exact copies meet in one aggregate with a map-side
minimum. Two fingerprints with at most ``max_bits`` different bits agree on at least ``blocks - max_bits``
of the blocks, so each fingerprint is filed under every choice of that many blocks. With eight blocks of
eight bits and two differing bits those are 28 keys, and a bucket can hold no more than 2**16 distinct
fingerprints whatever the input, because only 16 bits are free in it. Inside a bucket close pairs are
found by looking up flipped bits, never by pairing rows, and only one link per member leaves it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from peerlens.llm.common import aside, batches, streams, table, text_bytes

BITS, BLOCKS, MAX_BITS, SHINGLE = 64, 8, 2, 3
#: Near copies by similarity: words of a shingle, least Jaccard similarity, 64-bit lanes of a fingerprint (four 16-bit blocks
#: each), differing bits of the first 128 that are let through to the exact check, rows of buckets compared at a time.
STAGE_SHINGLE, SIMILARITY, LANES, RADIUS, SLICE = 5, 0.8, 14, 30, 8192
#: Pairs of a shared part that leave a task at a time; rows in which common parts are looked for, and how many of these are kept.
PAIRS, SAMPLE, COMMON = 1 << 18, 16_384, 65_536
#: Likely pairs a row of one key from which its rows go to ``dense_links`` instead; rows and bytes of hashes of a tile there, hashes counted at a time.
DENSE, TILE_ROWS, TILE_BYTES, COLUMNS = 4, 512, 8 << 20, 4096
#: Pairs a row of one key up to which their sizes and places are looked at one by one; beyond, all rows of the key are dense.
LOOSE = 256
#: Bits of the parity marks of a set.
MARKS = 1024
#: Buckets up to this many rows are compared in full. Of the 64 * LANES bits, 135 +- 11 differ at a similarity of 0.8 and 206 +- 13 at 0.6;
#: pairs with more than this many are left to ``sharing_pairs``.
SMALL, WIDE_RADIUS = 16, 165
_WIDTH = BITS // BLOCKS


def fingerprint(text: bytes, words: int = SHINGLE, seed: int = 42) -> int:
    """SimHash of one text: bit set where more than half of the shingle hashes have it; no word gives zero."""
    parts = text.lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    digest = xxhash.xxh64_intdigest
    n = len(parts)
    if n <= words:
        hashes = [digest(joined, seed)]
    else:
        ends = np.cumsum(np.fromiter(map(len, parts), np.int64, n) + 1)
        starts = (ends - np.fromiter(map(len, parts), np.int64, n) - 1)[: n - words + 1].tolist()
        hashes = [digest(joined[s:e], seed) for s, e in zip(starts, (ends[words - 1 :] - 1).tolist(), strict=True)]
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        part = np.array(hashes[at : at + (1 << 14)], ">u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = np.array([fingerprint(t, words) for t in text_bytes(batch.column(1))], np.uint64)
        return pa.record_batch([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return batches(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), run, "doc_id long, fp long")


def _bucket_links(free: np.ndarray, max_bits: int) -> np.ndarray:
    """For each of the distinct values, the position of the smallest member of its cluster in this bucket."""
    n = len(free)
    root = np.arange(n)

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    if n <= 48:
        left, right = np.nonzero(np.triu(np.bitwise_count(free[:, None] ^ free[None, :]) <= max_bits, 1))
    else:
        place = np.full(1 << (2 * _WIDTH), -1, np.int32)
        place[free] = np.arange(n)
        bits = [1 << b for b in range(2 * _WIDTH)]
        left, right = [], []
        for flip in bits + [a | b for a, b in combinations(bits, 2)] * (max_bits > 1):
            other = place[free ^ flip]
            i = np.nonzero(other > np.arange(n))[0]
            left.append(i)
            right.append(other[i])
        left, right = np.concatenate(left), np.concatenate(right)
    for i, j in zip(left.tolist(), right.tolist(), strict=True):
        a, b = find(i), find(j)
        if a != b:
            root[max(a, b)] = min(a, b)
    return np.array([find(i) for i in range(n)])


def links(distinct: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(a, b): links between distinct fingerprints (column fp) whose connected groups are those of all close pairs.

    Every link joins two fingerprints of one group; a pair within ``max_bits`` bits is always joined by a path.
    """
    if not 1 <= max_bits <= 2:
        raise ValueError("max_bits must be 1 or 2: more would need more blocks")
    masks = [sum(0xFF << (_WIDTH * (BLOCKS - 1 - b)) for b in free) for free in combinations(range(BLOCKS), MAX_BITS)]
    signed = lambda x: x - (1 << 64) if x >= 1 << 63 else x
    keys = F.array(*[F.struct(F.lit(k).cast("byte").alias("k"), F.col("fp").bitwiseAND(F.lit(signed(~m & (1 << 64) - 1)).cast("long")).alias("rest")) for k, m in enumerate(masks)])
    filed = distinct.select("fp", F.explode(keys).alias("key")).select("key.k", "key.rest", "fp")
    # A bucket has at most 2**16 distinct members, see above.
    buckets = filed.groupBy("k", "rest").agg(F.collect_list("fp").alias("members")).where(F.size("members") > 1)
    free_blocks = list(combinations(range(BLOCKS), MAX_BITS))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        a, b = [], []
        offsets = batch.column(1).offsets.to_numpy()
        values = batch.column(1).values.to_numpy().view(np.uint64)
        for k, s, e in zip(batch.column(0).to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            members = np.unique(values[s:e])
            hi, lo = (np.uint64(_WIDTH * (BLOCKS - 1 - x)) for x in free_blocks[k])
            free = (((members >> hi) & np.uint64(0xFF)) << np.uint64(_WIDTH) | (members >> lo) & np.uint64(0xFF)).astype(np.int64)
            root = _bucket_links(free, max_bits)
            other = np.nonzero(root != np.arange(len(root)))[0]
            a.append(members[root[other]])
            b.append(members[other])
        return pa.record_batch([pa.array(np.concatenate(x).view(np.int64)) for x in (a, b)], ["a", "b"])

    return batches(buckets.select("k", "members"), run, "a long, b long").distinct()


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(fp, label): smallest label of each connected group, for the fingerprints that have an edge.

    ``nodes`` has (fp, label). Labels pass along edges and jump to the label of their own label until none changes;
    each round is a written table of one row per linked fingerprint. A fingerprint has few edges, so no key is hot.
    """
    both = aside(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).distinct(), "simhash-edges")
    labels = aside(nodes.join(both.select(F.col("a").alias("fp")).distinct(), "fp").select("fp", "label"), "simhash-labels")
    while True:
        near = both.join(labels.select(F.col("fp").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("near"))
        stepped = labels.join(near.select(F.col("a").alias("fp"), "near"), "fp").select("fp", F.least("label", "near").alias("label"), F.col("label").alias("old"))
        stepped = aside(stepped, "simhash-step")
        moved = stepped.where("label < old")
        if moved.isEmpty():
            return labels
        # old label -> smallest label any of its holders has met: carries a group's minimum to all its holders at once.
        jump = moved.groupBy("old").agg(F.min("label").alias("jump"))
        labels = aside(stepped.join(jump, "old", "left").select("fp", F.least("label", F.coalesce("jump", "label")).alias("label")), "simhash-labels")


def near_duplicates(docs: DataFrame, max_bits: int = MAX_BITS, words: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id), one row per input row.

    Null and wordless texts have fingerprint zero and are linked like any other. Repeated rows stay, each with its
    group. Ids are whole numbers. A null id never names a group: it counts as larger than every id; a group of null ids only gets null.
    Other columns of the input are not looked at.
    """
    last = F.lit((1 << 63) - 1)
    marked = aside(fingerprints(docs, words, id_col, text_col), "simhash-docs")
    nodes = marked.groupBy("fp").agg(F.coalesce(F.min("doc_id"), last).alias("label"))
    nodes = aside(nodes, "simhash-nodes")
    labels = components(nodes, links(nodes.select("fp"), max_bits))
    named = nodes.join(labels.withColumnRenamed("label", "linked"), "fp", "left").select("fp", F.coalesce("linked", "label").alias("label"))
    return marked.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.nullif("label", last).alias("component_id"))


def keep_first(docs: DataFrame, max_bits: int = MAX_BITS, words: int = SHINGLE) -> DataFrame:
    """Documents without their near-duplicates: one row of each group stays, whole.

    It is the row with the smallest doc_id, a null one last; of rows that share it the one with the smallest text hash.
    Rows are told apart by numbers of their own, so null and repeated ids say nothing about the texts.
    """
    # Row numbers are fixed by writing them.
    row = _unused(docs)
    rows = aside(docs.withColumn(row, F.monotonically_increasing_id()), "simhash-rows")
    found = near_duplicates(rows, max_bits, words, id_col=row).select(F.col("doc_id").alias("row"), "component_id")
    first = found.join(rows.select(F.col(row).alias("row"), _order(row).alias("order")), "row").groupBy("component_id").agg(F.min("order").alias("order"))
    return rows.join(first.select(F.col("order.row").alias(row)), row, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])


def _unused(docs: DataFrame) -> str:
    """A column name that the table does not have."""
    name = "_row"
    while name in docs.columns:
        name += "_"
    return name


def _order(row: str) -> Column:
    return F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.xxhash64(F.col("text").cast("string")).alias("hash"), F.col(row).alias("row"))


# Near copies by similarity


def shingle_set(text: bytes, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a text; fewer words make one shingle, none make none."""
    parts = text.lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    joined = b" ".join(parts)
    if len(parts) <= words:
        return np.array([xxhash.xxh3_64_intdigest(joined)], np.uint64)
    ends = np.cumsum([len(p) + 1 for p in parts])
    starts = np.concatenate([[0], ends[:-words]]).tolist()
    digest = xxhash.xxh3_64_intdigest
    return np.unique(np.array([digest(joined[s:e]) for s, e in zip(starts, (ends[words - 1 :] - 1).tolist(), strict=True)], np.uint64))


def _lane(hashes: np.ndarray, lane: int) -> np.ndarray:
    """Another 64 independent-looking bits of each hash (the finaliser of splitmix64)."""
    x = hashes + np.uint64((0x9E37_79B9_7F4A_7C15 * (lane + 1)) % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58_476D_1CE4_E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D0_49BB_1331_11EB)
    return x ^ (x >> np.uint64(31))


def wide_fingerprint(hashes: np.ndarray, lanes: int) -> np.ndarray:
    """A SimHash of 64 * lanes bits as big-endian bytes."""
    out = np.empty(lanes * 8, np.uint8)
    for lane in range(lanes):
        ones = np.zeros(BITS, np.int64)
        for at in range(0, len(hashes), 1 << 12):
            part = _lane(hashes[at : at + (1 << 12)], lane).astype(">u8")
            ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.uint16)
        out[lane * 8 : lane * 8 + 8] = np.packbits(2 * ones > len(hashes))
    return out


def _differ(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x ^ y).sum(axis=-1).astype(np.int32)


def _small_buckets(keys: np.ndarray, prints: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(earlier row, row, differing bits) of all rows of equal neighbouring keys within ``most`` bits; keys have at most ``SMALL`` rows."""
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32))]
    for step in range(1, SMALL):
        at = np.flatnonzero(keys[step:] == keys[:-step])
        if not len(at):
            break
        bits = _differ(prints[at], prints[at + step])
        near = bits <= most
        found.append((at[near], at[near] + step, bits[near]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _large_bucket(prints: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(leader, row, differing bits) and the leaders: each row's first leader within half of ``most`` bits.

    A row further than that from all earlier leaders is one itself, so a large group of near copies has few; it is
    linked to the nearest earlier leader within ``most``.
    """
    best, place, leaders = np.full(len(prints), most + 1, np.int32), np.zeros(len(prints), np.int64), []
    open_ = np.ones(len(prints), bool)
    while open_.any():
        leader = int(open_.argmax())
        leaders.append(leader)
        open_[leader] = False
        rest = np.flatnonzero(open_)
        bits = _differ(prints[rest], prints[leader])
        nearer = bits < best[rest]
        best[rest[nearer]], place[rest[nearer]] = bits[nearer], leader
        near = bits <= most // 2
        best[rest[near]], place[rest[near]] = bits[near], leader
        open_[rest[near]] = False
    found = np.flatnonzero(best <= most)
    return place[found], found, best[found], np.array(leaders)


def similar_links(reps: DataFrame, most: int = RADIUS) -> DataFrame:
    """(b, near): for a row the structs (bits, a) of earlier rows in the blocks it shares, within ``most`` of the 128 checked bits.

    ``reps`` has (row, keys, v1, v2). In a bucket of up to ``SMALL`` rows these are all, in a larger one it is a leader, so a row has a
    bounded number of links for each block, never all pairs of a bucket. A bucket is read in slices of ``SLICE`` rows whose leaders
    go on to the next slice, so that a group of near copies of any size is linked in bounded memory.
    """
    filed = reps.select(F.explode("keys").alias("key"), "row", "v1", "v2")
    n = int(reps.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, rows, prints = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros((0, 2), np.uint64)

        def links(end: bool) -> Iterator[pa.RecordBatch]:
            """Works on what is held; unless it is the end, the last key may go on, and its rows or leaders are kept."""
            nonlocal keys, rows, prints
            cuts = np.flatnonzero(np.diff(keys)) + 1
            starts, stops = np.append(0, cuts), np.append(cuts, len(keys))
            large = stops - starts > SMALL
            last = len(starts) - 1
            open_ = not end
            small = np.repeat(~large, stops - starts)
            if open_ and not large[last]:
                small[starts[last] :] = False
            own = np.flatnonzero(small)
            a, b, bits = _small_buckets(keys[own], prints[own], most)
            found = [(own[a], own[b], bits)]
            keep = np.arange(starts[last], stops[last]) if open_ else np.zeros(0, np.int64)
            for i in np.flatnonzero(large):
                a, b, bits, leaders = _large_bucket(prints[starts[i] : stops[i]], most)
                found.append((a + starts[i], b + starts[i], bits))
                if open_ and i == last:
                    keep = leaders + starts[i]
            a, b, bits = (np.concatenate(x) for x in zip(*found, strict=True))
            out = pa.record_batch([pa.array(rows[a]), pa.array(rows[b]), pa.array(bits)], ["a", "b", "bits"])
            keys, rows, prints = keys[keep], rows[keep], prints[keep]
            if out.num_rows:
                yield out

        fresh = 0
        for part in parts:
            k, ids, v1, v2 = (c.to_numpy() for c in part.columns)
            keys, rows, prints = np.concatenate([keys, k]), np.concatenate([rows, ids]), np.concatenate([prints, np.stack([v1, v2], axis=1).view(np.uint64)])
            fresh += len(k)
            if fresh >= SLICE:
                yield from links(False)
                fresh = 0
        if len(keys):
            yield from links(True)

    ready = filed.repartition(n, "key").sortWithinPartitions("key", "row")
    found = streams(ready, run, "a long, b long, bits int")
    # Fewer than SMALL entries a block.
    return found.groupBy("b").agg(F.sort_array(F.collect_set(F.struct("bits", "a"))).alias("near"))


def _rare_first(hashes: np.ndarray, similarity: float, common: np.ndarray | None = None, counts: np.ndarray | None = None) -> np.ndarray:
    """The first hashes of a set in the order by (count in ``common``, hash), as many as a similar set cannot all lack; none of a set too small
    to have a similar one besides itself."""
    size = len(hashes)
    if size < similarity * (size + 1) - 1e-9:
        return hashes[:0]
    keep = size - math.ceil(similarity * size - 1e-9) + 1
    if common is None or not len(common):
        return hashes[:keep]
    at = np.minimum(np.searchsorted(common, hashes), len(common) - 1)
    return hashes[np.argsort(np.where(common[at] == hashes, counts[at], 0), kind="stable")[:keep]]


def part_keys(hashes: np.ndarray, similarity: float, common: np.ndarray | None = None, counts: np.ndarray | None = None) -> np.ndarray:
    """Hashes of a set of sorted hashes such that any two different sets of Jaccard similarity ``similarity`` or more share one of them.

    Two similar sets have all but a share ``1 - similarity`` of the hashes of each in common, so of the hashes in any one order of all of them it is
    enough to keep the first such share and one more. The order is by the counts of ``common`` hashes (sorted; others count zero), so that
    texts with common passages share few keys; which hashes are taken for common changes the work, not the result.
    """
    return _rare_first(hashes, similarity, common, counts)


def parity_marks(hashes: np.ndarray) -> np.ndarray:
    """``MARKS`` bits as longs: which of as many shares of all hashes hold an odd number of the set's. Two sets differ in at most as many bits as
    hashes lie in only one of them."""
    odd = np.bincount((_lane(hashes, LANES) % np.uint64(MARKS)).astype(np.int64), minlength=MARKS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _may_be_similar(size: np.ndarray, place: np.ndarray, i: np.ndarray, j: np.ndarray, similarity: float) -> np.ndarray:
    """Whether two sets that share the key at these places of their orders, and none before, can be similar: what follows must be enough."""
    return np.minimum(size[i] - place[i], size[j] - place[j]) >= similarity / (1 + similarity) * (size[i] + size[j]) - 1e-9


def _cross_pairs(keys: np.ndarray, labels: np.ndarray, dense: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """All places (i, j) of equal keys and different labels, about ``PAIRS`` at a time; the rows are sorted by key and label.

    A key with more than ``dense`` pairs a row gives, marked as such, its first place with each other one instead.
    """
    turn = np.diff(keys) != 0
    ends = lambda cut: np.repeat(x := np.append(np.flatnonzero(cut) + 1, len(keys)), np.diff(x, prepend=0))
    start, stop = ends(turn | (np.diff(labels) != 0)), ends(turn)
    count = stop - start
    if dense is not None and len(keys):
        first = np.append(0, np.flatnonzero(turn) + 1)
        size = stop[first] - first
        many = np.repeat(np.add.reduceat(count, first) > dense * size, size)
        if many.any():
            yield np.repeat(first, size)[many], np.flatnonzero(many), True
            count = np.where(many, 0, count)
    live = np.flatnonzero(count)
    total = np.cumsum(count[live])
    cuts = np.searchsorted(total, np.arange(PAIRS, total[-1], PAIRS)) if len(live) else []
    for own in np.split(live, np.unique(cuts)) if len(live) else ():
        n = count[own]
        i = np.repeat(own, n)
        yield i, start[i] + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n), False


def _likely_pairs(keys: np.ndarray, labels: np.ndarray, rows: np.ndarray, size: np.ndarray, place: np.ndarray, similarity: float) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """(row, row, dense) of equal keys and different labels that can be similar by their sizes and places; the rows are sorted by key and label.

    A key with more than ``DENSE`` such pairs a row gives its first row in a pair with each other row in one instead, marked as dense.
    """
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for i, j, many in _cross_pairs(keys, labels, LOOSE):
        if many:
            yield rows[i], rows[j], True
        else:
            near = _may_be_similar(size, place, i, j, similarity)
            found.append((i[near], j[near]))
    i, j = (np.concatenate(x) for x in zip(*found, strict=True))
    if not len(i):
        return
    key = np.cumsum(np.diff(keys, prepend=keys[0]) != 0)
    many = (np.bincount(key[i], minlength=key[-1] + 1) > DENSE * np.bincount(key))[key[i]]
    if many.any():
        met = np.unique(np.concatenate([i[many], j[many]]))
        _, start, times = np.unique(key[met], return_index=True, return_counts=True)
        yield rows[np.repeat(met[start], times)], rows[met], True
    yield rows[i[~many]], rows[j[~many]], False


def sharing_pairs(texts: DataFrame, groups: DataFrame, similarity: float = SIMILARITY, words: int = STAGE_SHINGLE) -> DataFrame:
    """(a, b, dense): all pairs a < b of rows of different labels whose shingle sets share a key of ``part_keys`` and can be similar.

    ``texts`` has (row, text), ``groups`` (row, label). Every pair of different sets that is similar enough and not yet of one label is among them. A key
    is a shingle, sent with the size of its set and its place in the order: a pair whose sets are too different in size, or have too little after
    the place, is no similar one that meets here first. Rows of one label make no pairs, so a group of near copies that is already
    linked costs nothing. Shingles that several of about ``SAMPLE`` rows have are common. A key with very many pairs gives ``dense`` rows instead, which join
    all its rows to one of them: all pairs of rows joined in this way, directly or not, are to be compared (``dense_links``).
    """
    n = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def every(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.record_batch([pa.array(np.concatenate([shingle_set(t, words) for t in text_bytes(batch.column(1))]).view(np.int64))], ["key"])

    # A label is the number of one of its rows, which stands for all.
    share = SAMPLE / max(groups.count(), 1)
    drawn = groups.where("row = label").where(F.pmod(F.xxhash64("row"), F.lit(1 << 30)) < int(min(share, 1.0) * (1 << 30)))
    often = batches(texts.join(drawn, "row").select("row", "text"), every, "key long").groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    often = often.where("n > 2").orderBy(F.desc("n"), "key").limit(COMMON).toPandas()
    common, counts = often["key"].to_numpy(np.int64).view(np.uint64), often["n"].to_numpy(np.int64)
    common, counts = common[order := np.argsort(common)], counts[order]

    def filed(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingle_set(t, words) for t in text_bytes(batch.column(2))]
        keys = [part_keys(s, similarity, common, counts) for s in sets]
        held = [len(k) for k in keys]
        each = np.repeat(np.arange(len(keys)), held)
        rows, labels = (batch.column(c).to_numpy()[each] for c in (0, 1))
        size = np.array([len(s) for s in sets], np.int32)[each]
        place = (np.arange(len(each)) - np.repeat(np.cumsum(held) - held, held)).astype(np.int32)
        return pa.record_batch([pa.array(np.concatenate(keys).view(np.int64)), pa.array(labels), pa.array(rows), pa.array(size), pa.array(place)], ["key", "label", "row", "size", "place"])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, fresh = [], 0

        def pairs(end: bool) -> Iterator[pa.RecordBatch]:
            """Works on whole keys; unless it is the end, the last key may go on and its rows are kept."""
            nonlocal held
            columns = [np.concatenate(x) for x in zip(*held, strict=True)]
            done = len(columns[0]) if end else int(np.searchsorted(columns[0], columns[0][-1]))
            for a, b, many in _likely_pairs(*[c[:done] for c in columns], similarity) if done else ():
                yield pa.record_batch([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(np.full(len(a), many))], ["a", "b", "dense"])
            held = [tuple(c[done:] for c in columns)]

        for part in parts:
            held.append(tuple(c.to_numpy() for c in part.columns))
            fresh += part.num_rows
            if fresh >= max(SLICE, len(held[0][0])):
                yield from pairs(False)
                fresh = 0
        if held:
            yield from pairs(True)

    keyed = batches(texts.join(groups, "row").select("row", "label", "text"), filed, "key long, label long, row long, size int, place int")
    ready = keyed.repartition(n, "key").sortWithinPartitions("key", "label", "row")
    return streams(ready, run, "a long, b long, dense boolean").distinct()


def _similar_in(hashes: list[np.ndarray], left: np.ndarray, right: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Places (i of left, j of right) of similar sets, from the products of their incidence matrices, some hashes at a time."""
    sizes = np.array([len(h) for h in hashes])
    row = np.repeat(np.arange(len(hashes)), sizes)
    _, code, times = np.unique(np.concatenate(hashes), return_inverse=True, return_counts=True)
    own = times[code] > 1
    row, code = row[own], (np.cumsum(times > 1) - 1)[code[own]]
    order = np.argsort(code, kind="stable")
    row, code = row[order], code[order]
    shared = np.zeros((len(left), len(right)))
    for lo in range(0, int(code[-1]) + 1 if len(code) else 0, COLUMNS):
        s, e = np.searchsorted(code, [lo, lo + COLUMNS])
        m = np.zeros((len(hashes), COLUMNS), np.float32)
        m[row[s:e], code[s:e] - lo] = 1
        shared += m[left] @ m[right].T
    return np.nonzero(shared >= similarity * (sizes[left][:, None] + sizes[right][None, :] - shared))


def dense_links(sets: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(a, b): pairs of different labels that hold two similar sets; ``sets`` has (block, row, label, hashes), all pairs of a block are compared.

    A block goes in hash tiles of about ``TILE_ROWS`` rows or ``TILE_BYTES``; a task sees two tiles.
    """
    sized = sets.groupBy("block").agg(F.greatest(F.ceil(F.count(F.lit(1)) / TILE_ROWS), F.ceil(F.sum(F.octet_length("hashes")) / TILE_BYTES), F.lit(1)).cast("int").alias("tiles"))
    tiled = sets.join(sized, "block").withColumn("tile", F.pmod(F.xxhash64("row"), F.col("tiles")).cast("int"))
    met = tiled.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    met = met.select("block", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"), "tile", "label", "hashes")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        tile, label = pdf["tile"].to_numpy(), pdf["label"].to_numpy()
        left, right = np.flatnonzero(tile == pdf["i"].iloc[0]), np.flatnonzero(tile == pdf["j"].iloc[0])
        i, j = _similar_in([np.frombuffer(h, np.uint64) for h in pdf["hashes"]], left, right, similarity)
        a, b = label[left[i]], label[right[j]]
        return pd.DataFrame({"a": a[a != b], "b": b[a != b]}).drop_duplicates()

    return met.groupBy("block", "i", "j").applyInPandas(run, "a long, b long").distinct()


def keep_dissimilar(docs: DataFrame, words: int = STAGE_SHINGLE, similarity: float = SIMILARITY, most: int = RADIUS) -> DataFrame:
    """Documents without their near copies: of texts joined by pairs of Jaccard similarity ``similarity`` or more over their sets of
    ``words``-word shingles one row stays, whole.

    A fingerprint of 64 * ``LANES`` bits is cut into 16-bit blocks. Two texts of similarity 0.8 differ in a bit with
    probability 0.15, so they share one of 56 blocks with probability 0.98 and, within ``RADIUS`` of 128 bits, pass the check of the distance
    with 0.99; candidates whose whole fingerprints are close, too, are decided by the exact similarity of the shingle sets. What the blocks
    miss is found by ``sharing_pairs``, which leaves out no pair: texts still in different groups that share a rare shingle, and whose
    sizes, places and parity marks allow it, are compared exactly.
    Equal sets (copies in other letter case or spacing, too) meet in an aggregate and need no blocks.

    The row with the smallest doc_id stays, a null one last; of rows that share it the one with the smallest text hash. Rows are
    told apart by numbers of their own, so ids may be null, repeated or of any type. Texts without words (null, empty) are
    copies of each other. All columns come back as they were, whatever their names.
    """
    row = _unused(docs)
    rows = aside(docs.withColumn(row, F.monotonically_increasing_id()), "similar-rows")
    texts = rows.select(F.col(row).alias("row"), F.col("text").cast("string").alias("text"))

    def prints(batch: pa.RecordBatch) -> pa.RecordBatch:
        same, keys, checked, sizes, marks = [], [], [], [], []
        for text in text_bytes(batch.column(1)):
            found = shingle_set(text, words)
            same.append(xxhash.xxh3_128_digest(found.tobytes()))
            wide = wide_fingerprint(found, LANES)
            keys.append(wide.view(">u2").astype(np.int32) + (np.arange(LANES * 4, dtype=np.int32) << 16))
            checked.append(wide[:16].view(">u8").astype(np.uint64).view(np.int64))
            sizes.append(len(found))
            marks.append(parity_marks(found).tolist())
        v = np.array(checked).reshape(-1, 2)
        return pa.record_batch([batch.column(0), pa.array(same, pa.binary()), pa.array([k.tolist() for k in keys], pa.list_(pa.int32())), pa.array(v[:, 0]), pa.array(v[:, 1]), pa.array(sizes, pa.int32()), pa.array(marks, pa.list_(pa.int64()))], ["row", "same", "keys", "v1", "v2", "size", "marks"])

    marked = aside(batches(texts, prints, "row long, same binary, keys array<int>, v1 long, v2 long, size int, marks array<long>"), "similar-prints")
    first = marked.groupBy("same").agg(F.min("row").alias("rep"))
    first = aside(first, "similar-sets")
    reps = marked.join(first.select(F.col("rep").alias("row")), "row", "left_semi")
    close = aside(similar_links(reps, most), "similar-candidates")
    def sets(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.record_batch([batch.column(0), pa.array([shingle_set(t, words).tobytes() for t in text_bytes(batch.column(1))], pa.binary())], ["row", "hashes"])

    def verify(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, x = None, None
        for batch in parts:
            keep = []
            for own, other in zip(text_bytes(batch.column(2)), text_bytes(batch.column(3)), strict=True):
                if own != last:  # the pairs of a row mostly follow each other
                    last, x = own, shingle_set(own, words)
                y = shingle_set(other, words)
                shared = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(shared >= similarity * (len(x) + len(y) - shared))
            kept = batch.filter(pa.array(keep, pa.bool_()))
            yield pa.record_batch([kept.column(0), kept.column(1)], ["a", "b"])

    def likely(pairs: DataFrame, name: str) -> DataFrame:
        """Pairs whose whole fingerprints are close enough for a similarity near the wanted one."""
        wide = marked.select("row", "keys")
        both = pairs.join(wide.select(F.col("row").alias("a"), F.col("keys").alias("ka")), "a").join(wide.select(F.col("row").alias("b"), F.col("keys").alias("kb")), "b")
        bits = F.aggregate(F.zip_with("ka", "kb", lambda x, y: F.bit_count(x.bitwiseXOR(y)).cast("int")), F.lit(0), lambda total, n: total + n)
        return aside(both.where(bits <= WIDE_RADIUS).select("a", "b"), f"{name}-likely")

    def possible(pairs: DataFrame, name: str) -> DataFrame:
        """Pairs whose parity marks do not rule the similarity out; no similar pair goes."""
        side = lambda c: marked.select(F.col("row").alias(c), F.col("size").alias(f"s{c}"), F.col("marks").alias(f"m{c}"))
        bits = F.aggregate(F.zip_with("ma", "mb", lambda x, y: F.bit_count(x.bitwiseXOR(y)).cast("int")), F.lit(0), lambda total, n: total + n)
        most = F.lit((1 - similarity) / (1 + similarity)) * (F.col("sa") + F.col("sb")) + F.lit(1e-6)
        return aside(pairs.join(side("a"), "a").join(side("b"), "b").where(bits <= most).select("a", "b"), f"{name}-possible")

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        # Texts travel, not their hashes, which are larger and do not compress.
        side = lambda c: texts.select(F.col("row").alias(c), F.col("text").alias(f"t{c}"))
        both = side("a").join(pairs.select("a").distinct(), "a", "left_semi").join(pairs.join(side("b"), "b"), "a")
        return aside(streams(both.select("a", "b", "ta", "tb"), verify, "a long, b long"), name)

    # The nearest of its candidates joins most texts to their group; the others are compared only across groups.
    edges = verified(likely(close.select(F.col("near")[0]["a"].alias("a"), "b"), "similar-nearest"), "similar-nearest")
    # Each row has one nearest, an earlier one: four steps up these trees tell most joined texts.
    roots = edges.select(F.col("b").alias("row"), F.col("a").alias("root"))
    for _ in range(2):
        up = roots.select(F.col("row").alias("root"), F.col("root").alias("above"))
        roots = roots.join(up, "root", "left").select("row", F.coalesce("above", "root").alias("root"))
    roots = aside(roots, "similar-roots")
    side = lambda c: roots.select(F.col("row").alias(c), F.col("root").alias(f"r{c}"))
    others = close.join(side("b"), "b", "left").select("b", "rb", F.explode(F.slice(F.col("near.a"), F.lit(2), F.size("near"))).alias("a"))
    apart = others.join(side("a"), "a", "left").where(F.coalesce("ra", "a") != F.coalesce("rb", "b"))
    edges = edges.unionByName(verified(likely(apart.select("a", "b"), "similar-others"), "similar-others"))
    nodes = first.join(roots.select(F.col("row").alias("rep"), "root"), "rep", "left").select(F.col("rep").alias("fp"), F.coalesce("root", "rep").alias("label"))
    labels = components(nodes, edges)
    linked = first.join(labels.select(F.col("fp").alias("rep"), F.col("label").alias("linked")), "rep", "left")
    named = aside(linked.select("same", "rep", F.coalesce("linked", "rep").alias("label")), "similar-groups")
    # The rest: all pairs of different groups that can be similar, and the groups they join.
    group = named.select(F.col("rep").alias("row"), "label")
    missed = aside(sharing_pairs(texts, group, similarity, words), "similar-sharing")
    of = lambda c: group.select(F.col("row").alias(c), F.col("label").alias(f"l{c}"))
    joined = verified(possible(missed.where("NOT dense").select("a", "b"), "similar-missed"), "similar-missed").join(of("a"), "a").join(of("b"), "b").select(F.col("la").alias("a"), F.col("lb").alias("b"))
    stars = missed.where("dense AND a <> b").select("a", "b")
    if not stars.isEmpty():
        blocks = components(group.select(F.col("row").alias("fp"), F.col("row").alias("label")), stars).select(F.col("fp").alias("row"), F.col("label").alias("block"))
        hashed = aside(batches(texts.join(blocks, "row", "left_semi").select("row", "text"), sets, "row long, hashes binary"), "similar-dense")
        joined = joined.unionByName(dense_links(hashed.join(blocks, "row").join(group, "row"), similarity))
    joined = aside(joined.distinct(), "similar-joined")
    whole = components(named.select(F.col("label").alias("fp"), "label").distinct(), joined)
    named = named.join(whole.select(F.col("fp").alias("label"), F.col("label").alias("whole")), "label", "left").select("same", F.coalesce("whole", "label").alias("label"))
    grouped = marked.select("row", "same").join(named, "same").select("row", "label")
    best = grouped.join(rows.select(F.col(row).alias("row"), _order(row).alias("order")), "row").groupBy("label").agg(F.min("order").alias("o"))
    return rows.join(best.select(F.col("o.row").alias(row)), row, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {"op10_simhash_near_dedup": op10_simhash_near_dedup}
SQL: dict[str, str] = {}
