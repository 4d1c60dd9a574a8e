"""Ranked lexical search: an index of compressed posting blocks in document shards, searched by Block-Max MaxScore.

A task that reads documents cuts them into shards of bounded text and writes each as one row: its terms, their postings in
blocks of 128, and for every block its last document and the pairs (tf, n) that no other posting of the block beats in
both. Term counts of the corpus are not in the index: they are sums over its rows, and the pairs give exact block maxima
under any of them. Nothing is shuffled to build it.

A search evaluates a block of queries in every shard. Lists whose summed upper bounds cannot exceed the current k-th score
are non-essential and give no candidates; a candidate's block maxima in them reject it before their blocks are
decompressed. Shards return k rows a query, and a window with a pushed-down limit merges them.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peerlens.llm.common import aside, streams, table, text_bytes
from peerlens.operators.neighbours import top_per_key

K = 20
#: Text bytes and documents of a shard (a longer text is a shard of its own), postings of a block, documents scored at a time.
SHARD_BYTES, SHARD_DOCS, BLOCK, WINDOW = 8 << 20, 1 << 16, 128, 512
#: (query, term) pairs evaluated together; a search with more takes several blocks of queries.
QUERY_TERMS, SALTS = 50_000, 64

#: What is no part of a term.
BREAKS = r"\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F"
_TERM = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WIDE = (None, np.dtype("<u1"), np.dtype("<u2"), None, np.dtype("<u4"))

INDEX = (
    "shard string, n_docs long, n_terms long, terms array<string>, df array<int>, doc_ids array<long>, lens binary, last binary, "
    "widths binary, pairs binary, pair_tf binary, pair_n binary, data binary"
)


# The index


def _frontier(block: np.ndarray, tf: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the postings that no other of their block beats with a larger tf and a smaller n; and their blocks."""
    order = np.lexsort((n, -tf, block))
    # Larger offsets in earlier blocks turn one running minimum into one per block.
    key = n[order] + (block[-1] - block[order]) * (int(n.max()) + 1)
    before = np.concatenate([[np.iinfo(np.int64).max], np.minimum.accumulate(key)[:-1]])
    kept = order[key < before]
    return kept, block[kept]


def shard_row(name: str, docs: list[tuple[int | None, Counter, int]]) -> dict:
    """One row of the index from (doc_id, term counts, number of terms); the documents are numbered by id, null ids last."""
    docs = sorted(docs, key=lambda d: (d[0] is None, d[0] or 0))
    lens = np.array([d[2] for d in docs], np.int64)
    words = pa.array([t for _, counts, _ in docs for t in counts], pa.binary()).dictionary_encode()
    code = words.indices.to_numpy()
    tf = np.fromiter((c for _, counts, _ in docs for c in counts.values()), np.int64, len(code))
    slot = np.repeat(np.arange(len(docs)), [len(counts) for _, counts, _ in docs])
    by_list = np.argsort(code, kind="stable")
    code, tf, slot = code[by_list], tf[by_list], slot[by_list]
    df = np.bincount(code, minlength=len(words.dictionary))
    start = np.cumsum(df) - df
    n_blocks = -(-df // BLOCK)
    block = np.repeat(np.cumsum(n_blocks) - n_blocks, df) + (np.arange(len(code)) - np.repeat(start, df)) // BLOCK
    first = np.concatenate([[True], block[1:] != block[:-1]])
    starts = np.nonzero(first)[0]
    count = np.diff(np.append(starts, len(code)))
    # Distance to the posting before, also across blocks; the first of a list counts from zero.
    delta = slot.copy()
    same = code[1:] == code[:-1]
    delta[1:][same] -= slot[:-1][same]
    wide_slot = np.where(np.maximum.reduceat(delta, starts) < 256, 1, 2)
    most = np.maximum.reduceat(tf, starts)
    wide_tf = np.where(most < 256, 1, np.where(most < 65_536, 2, 4))
    size = count * (wide_slot + wide_tf)
    at = np.cumsum(size) - size
    data = np.zeros(int(size.sum()), np.uint8)
    inside = np.arange(len(code)) - np.repeat(starts, count)
    for values, wide, base in ((delta, wide_slot, at), (tf, wide_tf, at + count * wide_slot)):
        each = np.repeat(wide, count)
        place = np.repeat(base, count) + inside * each
        for byte in range(4):
            has = each > byte
            data[place[has] + byte] = values[has] >> 8 * byte & 255
    kept, of = _frontier(block, tf, lens[slot])
    return {
        "shard": name,
        "n_docs": len(docs),
        "n_terms": int(lens.sum()),
        "terms": words.dictionary.cast(pa.string()),
        "df": df.astype(np.int32),
        "doc_ids": [d[0] for d in docs],
        "lens": lens.astype("<u4").tobytes(),
        "last": slot[np.append(starts[1:], len(code)) - 1].astype("<u2").tobytes(),
        "widths": (wide_slot * 16 + wide_tf).astype(np.uint8).tobytes(),
        "pairs": np.bincount(of, minlength=len(starts)).astype(np.uint8).tobytes(),
        "pair_tf": tf[kept].astype("<u4").tobytes(),
        "pair_n": lens[slot[kept]].astype("<u4").tobytes(),
        "data": data.tobytes(),
    }


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The index as a written table, one row per shard. Null, empty and termless texts are in no shard: they match nothing.

    Ids are whole numbers; null and repeated ids are documents of their own. Other columns are not looked at.
    """
    fields = [f.strip().split(" ") for f in INDEX.split(", ")]
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary(), "array<string>": pa.list_(pa.string()), "array<int>": pa.list_(pa.int32()), "array<long>": pa.list_(pa.int64())}

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, shards, docs, held = TaskContext.get().partitionId(), 0, [], 0

        def out() -> pa.RecordBatch:
            row = shard_row(f"{task}-{shards}", docs)
            return pa.record_batch([pa.array([row[name]], kinds[kind]) for name, kind in fields], [name for name, _ in fields])

        for part in parts:
            for i, text in zip(part.column(0).to_pylist(), text_bytes(part.column(1)), strict=True):
                if docs and (held + len(text) > shard_bytes or len(docs) == SHARD_DOCS):
                    yield out()
                    shards, docs, held = shards + 1, [], 0
                found = _TERM.findall(text.lower())
                if found:
                    docs.append((i, Counter(found), len(found)))
                    held += len(text)
        if docs:
            yield out()

    return aside(streams(docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")), run, INDEX), "search-index")


# The search


class Shard:
    """A row of the index, opened for one corpus (its N and L) and the terms of a block of queries."""

    def __init__(self, row: dict, terms: pa.Array, corpus: tuple[int, int]):
        self.data = row["data"]
        self.last = np.frombuffer(row["last"], "<u2").astype(np.int64)
        self.widths = np.frombuffer(row["widths"], np.uint8)
        self.df = row["df"].astype(np.int64)
        self.lens = np.frombuffer(row["lens"], "<u4").astype(np.int64)
        self.norm = self._norm(self.lens, corpus)
        n_blocks = -(-self.df // BLOCK)
        self.end = np.cumsum(n_blocks)
        self.begin = self.end - n_blocks
        self.count = np.full(len(self.last), BLOCK)
        self.count[self.end - 1] = self.df - BLOCK * (n_blocks - 1)
        size = self.count * ((self.widths >> 4) + (self.widths & 15))
        self.at = np.cumsum(size) - size
        self.base = np.concatenate([[0], self.last[:-1]])
        self.base[self.begin] = 0
        pairs = np.frombuffer(row["pairs"], np.uint8).astype(np.int64)
        best = self._impact(np.frombuffer(row["pair_tf"], "<u4").astype(np.int64), self._norm(np.frombuffer(row["pair_n"], "<u4").astype(np.int64), corpus))
        self.block_max = np.maximum.reduceat(best, np.cumsum(pairs) - pairs)
        self.list_max = np.maximum.reduceat(self.block_max, self.begin)
        place = pc.index_in(terms, value_set=row["terms"])
        self.place = place.fill_null(-1).to_numpy(zero_copy_only=False)
        self.open: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    @staticmethod
    def _norm(n: np.ndarray, corpus: tuple[int, int]) -> np.ndarray:
        return 100 - 25 + 25 * n * corpus[0] // corpus[1]

    @staticmethod
    def _impact(tf: np.ndarray, norm: np.ndarray) -> np.ndarray:
        return 1_000_000_000 * tf // (1000 * tf + 12 * norm)

    def block(self, b: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents and impacts of a block, decompressed once."""
        if b not in self.open:
            n, wide, at = int(self.count[b]), int(self.widths[b]), int(self.at[b])
            slots = self.base[b] + np.cumsum(np.frombuffer(self.data, _WIDE[wide >> 4], n, at).astype(np.int64))
            tf = np.frombuffer(self.data, _WIDE[wide & 15], n, at + n * (wide >> 4)).astype(np.int64)
            self.open[b] = slots, self._impact(tf, self.norm[slots])
        return self.open[b]

    def top(self, terms: np.ndarray, weights: np.ndarray, k: int, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores) of the k largest scores above zero, equal ones by document; terms are places in the block's list of terms."""
        place = self.place[terms]
        here = (place >= 0) & (weights > 0)
        place, weights = place[here], weights[here]
        bound = weights * self.list_max[place]
        order = np.argsort(bound, kind="stable")
        place, weights, total = place[order], weights[order], np.cumsum(bound[order])
        lists = [(int(w), int(b), int(e), self.last[b:e]) for w, b, e in zip(weights, self.begin[place], self.end[place], strict=True)]
        best, scores, least = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        for low in range(0, len(self.norm) if lists else 0, window):
            high = min(low + window, len(self.norm))
            # Documents later in the shard lose ties, so a bound equal to the k-th score is not enough.
            essential = int(np.searchsorted(total, least, "right"))
            if essential == len(lists):
                break
            found = np.zeros(high - low, np.int64)
            for w, b, e, last in lists[essential:]:
                for at in range(b + int(np.searchsorted(last, low)), min(e, b + int(np.searchsorted(last, high - 1)) + 1)):
                    slots, impact = self.block(at)
                    i, j = np.searchsorted(slots, (low, high))
                    found[slots[i:j] - low] += w * impact[i:j]
            slots = np.nonzero(found)[0]
            score = found[slots]
            slots = slots + low
            slots, score = self._finish(lists[:essential], slots, score, least)
            if len(slots):
                best, scores = np.concatenate([best, slots]), np.concatenate([scores, score])
                first = np.lexsort((best, -scores))[:k]
                best, scores = best[first], scores[first]
                least = int(scores[-1]) if len(scores) == k else 0
        return best, scores

    def _finish(self, lists: list, slots: np.ndarray, score: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Adds the non-essential lists, largest bound first; candidates that cannot exceed ``least`` go before a block is opened."""
        if lists:
            blocks = np.empty((len(lists), len(slots)), np.int64)
            bound = np.empty((len(lists), len(slots)), np.int64)
            for row, (w, b, e, last) in enumerate(lists):
                at = np.searchsorted(last, slots)
                out = at == e - b
                blocks[row] = b + np.where(out, 0, at)
                bound[row] = np.where(out, 0, w * self.block_max[blocks[row]])
            upto = np.cumsum(bound, axis=0)
            alive = np.nonzero(score + upto[-1] > least)[0]
            for row in range(len(lists) - 1, -1, -1):
                for at in np.unique(blocks[row, alive[bound[row, alive] > 0]]).tolist():
                    inside, impact = self.block(at)
                    mine = alive[(blocks[row, alive] == at) & (bound[row, alive] > 0)]
                    place = np.minimum(np.searchsorted(inside, slots[mine]), len(inside) - 1)
                    hit = inside[place] == slots[mine]
                    score[mine[hit]] += lists[row][0] * impact[place[hit]]
                if row:
                    alive = alive[score[alive] + upto[row - 1, alive] > least]
            slots, score = slots[alive], score[alive]
        above = score > least
        return slots[above], score[above]


def query_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item, id, term, tf): the terms of each row of ``items``, which the written row number ``item`` tells apart."""
    rows = aside(items.select(F.monotonically_increasing_id().alias("item"), F.col(id_col).alias("id"), F.translate(F.col(text_col).cast("string"), _UPPER, _LOWER).alias("text")), "search-items")
    term = F.explode(F.regexp_extract_all("text", F.lit(f"[^{BREAKS}]+"), F.lit(0)))
    return rows.select("item", "id", term.alias("term")).groupBy("item", "id", "term").agg(F.count("*").alias("tf"))


def search(index: DataFrame, items: DataFrame, k: int = K, id_col: str = "item_id", text_col: str = "text", query_block: int = QUERY_TERMS, window: int = WINDOW) -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents of largest score above zero for each row of ``items``.

    Equal scores rank by doc_id, a null one last. Null and termless items, an empty index and empty items have no rows;
    repeated items and repeated documents have rows each. The items are not collected: they meet the shards in blocks of at most
    ``query_block`` (item, term) pairs, or one longer item. A single block, of proven size, is broadcast; more are joined by salted keys.
    """
    asked = aside(query_terms(items, id_col, text_col), "search-terms")
    corpus = index.agg(F.sum("n_docs"), F.sum("n_terms")).first()
    if corpus[0] is None:
        corpus = (0, 1)
    entries = index.select(F.explode(F.arrays_zip("terms", "df")).alias("e")).select(F.col("e.terms").alias("term"), F.col("e.df").alias("df"))
    df = entries.join(asked.select("term").distinct(), "term").groupBy("term").agg(F.sum("df").alias("df"))
    weight = F.floor(F.lit(1000.0) * F.log((2.0 * corpus[0] + 2.0) / (2.0 * F.col("df") + 1.0))).cast("long")
    weighed = asked.join(df.select("term", weight.alias("w")), "term").select("item", "id", "term", (F.col("tf") * F.col("w")).alias("w"))
    weighed = aside(weighed.where("w > 0"), "search-weights")
    n = max(1, -(-weighed.count() // query_block))
    block = F.pmod(F.xxhash64("item"), F.lit(n)).cast("int")
    # One row per block of queries: bounded by query_block pairs, up to the unevenness of the hash.
    blocks = weighed.groupBy(block.alias("block")).agg(F.collect_list(F.struct("item", "term", "w")).alias("queries"))
    if n == 1:
        pairs = index.withColumn("block", F.pmod(F.xxhash64("shard"), F.lit(n)).cast("int")).join(F.broadcast(blocks), "block")
    else:
        salted = blocks.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        copies = index.withColumn("salt", F.pmod(F.xxhash64("shard"), F.lit(SALTS)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
        pairs = copies.join(salted, ["block", "salt"])
    names = [f.split(" ")[0] for f in INDEX.split(", ")]
    corpus = int(corpus[0]), max(1, int(corpus[1]))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for i in range(part.num_rows):
                row = {name: part.column(name)[i] for name in [*names, "queries"]}
                yield _search_shard(row, corpus, k, window)

    found = streams(pairs.select(*names, "queries"), run, "item long, doc_id long, score long")
    ranked = top_per_key(found, "item", [F.desc("score"), F.asc_nulls_last("doc_id")], k)
    ids = asked.select("item", "id").distinct()
    return ranked.join(ids, "item").select(F.col("id").alias(id_col), F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def _search_shard(row: dict, corpus: tuple[int, int], k: int, window: int) -> pa.RecordBatch:
    queries = row["queries"].values
    item, words, weights = (queries.field(x) for x in ("item", "term", "w"))
    words = words.dictionary_encode()
    item, weights, code = item.to_numpy(), weights.to_numpy(), words.indices.to_numpy()
    opened = {name: row[name].as_py() for name in ("data", "last", "widths", "lens", "pairs", "pair_tf", "pair_n")}
    shard = Shard(opened | {"terms": row["terms"].values, "df": row["df"].values.to_numpy()}, words.dictionary, corpus)
    order = np.argsort(item, kind="stable")
    cuts = np.append(np.nonzero(np.diff(item[order], prepend=item[order[:1]] - 1))[0], len(order))
    out_item, out_slot, out_score = [], [], []
    for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        slots, scores = shard.top(code[order[s:e]], weights[order[s:e]], k, window)
        out_item.append(np.full(len(slots), item[order[s]]))
        out_slot.append(slots)
        out_score.append(scores)
    ids = row["doc_ids"].values.take(pa.array(np.concatenate(out_slot)))
    return pa.record_batch([pa.array(np.concatenate(out_item), pa.int64()), ids, pa.array(np.concatenate(out_score), pa.int64())], ["item", "doc_id", "score"])


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best documents for each benchmark item."""
    return search(build_index(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


QUERIES = {"op11_ranked_search": op11_ranked_search}

_TERMS_SQL = rf"regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[^{BREAKS}]+')"
SQL = {
    "op11_ranked_search": f"""
WITH t AS (SELECT doc_id, unnest({_TERMS_SQL}) AS term FROM documents),
p AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
d AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM p GROUP BY ALL),
c AS (SELECT count(*) AS n, sum(n)::BIGINT AS l FROM d),
m AS (SELECT doc_id, 75 + (25 * d.n * c.n) // c.l AS m FROM d, c),
w AS (SELECT term, floor(1000 * ln((2 * (SELECT n FROM c) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM p GROUP BY term),
q AS (SELECT item_id, unnest({_TERMS_SQL}) AS term FROM benchmark),
s AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
  FROM q JOIN w USING (term) JOIN p USING (term) JOIN m USING (doc_id) GROUP BY ALL),
r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM s WHERE score > 0)
SELECT * FROM r WHERE rank <= {K}
"""
}
