"""Exact nearest neighbours by cosine: tiled matrix products with a running top-k, then one merge."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from peerlens.functions import arrays as A
from peerlens.operators.tiles import DIGITS, TILE_ROWS, matrix

SEGMENT_ROWS = 131_072
#: A query tile grows to this many rows while its vectors and best k stay below ``TILE_VALUES`` numbers; scores of a block are as many at most.
QUERY_ROWS, TILE_VALUES = 16_384, 1 << 22


def top_per_key(df: DataFrame, key, order: list, k: int, rank: str = "rank") -> DataFrame:
    """First k rows per key. The limit is pushed below the shuffle, so a hot key sends k rows per task."""
    keys = [key] if isinstance(key, str) else list(key)
    w = Window.partitionBy(*keys).orderBy(*order)
    first = df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)
    return first.withColumn(rank, F.col(rank).cast("long"))


def best_columns(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, columns) of the k largest finite scores of each row, largest first, equal ones in column order."""
    if scores.shape[1] > k:
        least = np.partition(scores, scores.shape[1] - k, axis=1)[:, -k][:, None]
        row, col = np.nonzero((scores >= least) & (scores > -np.inf))
    else:
        row, col = np.nonzero(scores > -np.inf)
    order = np.lexsort((col, -scores[row, col], row))
    row, col = row[order], col[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    return row[place < k], col[place < k]


def knn_cosine(
    queries: DataFrame,
    items: DataFrame,
    q_key: str,
    i_key: str,
    q_vec: str,
    i_vec: str,
    k: int,
    *,
    skip_same: bool = False,
    min_score: float | None = None,
    not_within: tuple[str, str] | None = None,
    tile_rows: int | None = None,
    segment_rows: int | None = None,
) -> DataFrame:
    """(query, item, score, rank): the k items of largest cosine, scores rounded to 6 digits, ties by item key.

    Queries are cut into hash tiles and items into hash segments; the counts of both follow
    from the row counts (see ``cuts``). A task unit holds one query tile, streams the items of one segment past it
    in blocks and lets out k rows per query. ``not_within`` names a block column of each side (a
    fold, say): an item of the query's own block is no candidate; a NULL block never matches.
    """
    tasks = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    asked, width = queries.agg(F.count(F.lit(1)), F.max(F.size(q_vec))).first()
    tiles, segments = cuts(asked, items.count(), max(1, width or 1), k, tasks, tile_rows, segment_rows)
    q_type, i_type = queries.schema[q_key].dataType, items.schema[i_key].dataType
    # Vectors travel as they are stored where both sides are alike; they are doubles in the products either way.
    stored = queries.schema[q_vec].dataType == items.schema[i_vec].dataType == T.ArrayType(T.FloatType())

    def side(df, key, vec, is_query):
        mine, other = (tiles, segments) if is_query else (segments, tiles)
        own = F.pmod(F.xxhash64(key), F.lit(mine)).cast("int")
        each = F.explode(F.sequence(F.lit(0), F.lit(other - 1)))
        block = F.col(not_within[0 if is_query else 1]).cast("long") if not_within else F.lit(None).cast("long")
        t = df.select(F.col(key).alias("_k"), (F.col(vec) if stored else A.doubles(vec)).alias("_v"), block.alias("_b"), own.alias("_own"), each.alias("_each"))
        qt, seg = ("_own", "_each") if is_query else ("_each", "_own")
        q_id = F.col("_k") if is_query else blank(q_type)
        i_id = blank(i_type) if is_query else F.col("_k")
        return t.select(
            F.col(qt).alias("_qt"), F.col(seg).alias("_seg"), F.lit(0 if is_query else 1).alias("_side"),
            q_id.alias("_qk"), i_id.alias("_ik"), F.coalesce("_b", F.lit(-1 if is_query else -2)).alias("_b"), "_v",
        )

    names = ["_q", "item", "score"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = None
        for pdf in batches:
            unit = pdf["_qt"].to_numpy().astype(np.int64) * segments + pdf["_seg"].to_numpy()
            cuts = np.flatnonzero(np.diff(unit)) + 1
            for part, u in zip(np.split(np.arange(len(pdf)), cuts), unit[np.concatenate([[0], cuts])] if len(pdf) else []):
                if best is None or best.unit != u:
                    if best is not None and best.q is not None:
                        yield best.result(names)
                    best = _Running(u, k, skip_same, min_score)
                best.add(pdf.iloc[part])
        if best is not None and best.q is not None:
            yield best.result(names)

    both = side(queries, q_key, q_vec, True).unionByName(side(items, i_key, i_vec, False))
    ready = both.repartition(tasks, "_qt", "_seg").sortWithinPartitions("_qt", "_seg", "_side", "_qk", "_ik")
    schema = T.StructType(
        [T.StructField("_q", q_type), T.StructField("item", i_type), T.StructField("score", T.DoubleType())]
    )
    part = ready.mapInPandas(run, schema).withColumn("score", F.col("score") + F.lit(0.0))
    out = top_per_key(part, "_q", [F.desc("score"), F.col("item")], k)
    return out.withColumnRenamed("_q", q_key)


def cuts(queries: int, items: int, width: int, k: int, tasks: int, tile_rows: int | None = None, segment_rows: int | None = None) -> tuple[int, int]:
    """Numbers of query tiles and item segments that move few rows: an item goes out once per tile, a query once per segment.

    A tile is as long as memory allows and a segment bounded. If that gives fewer units than two a task, both are cut
    further in like measure, but not into units of fewer than (2 * ``TILE_ROWS``) squared pairs. Sizes that are given are kept.
    """
    longest = max(TILE_ROWS, min(QUERY_ROWS, TILE_VALUES // (width + 2 * k)))
    tiles = max(1, -(-queries // (tile_rows or longest)))
    segments = max(1, -(-items // (segment_rows or max(SEGMENT_ROWS, 64 * k))))
    wanted = min(2 * tasks, queries * items // (2 * TILE_ROWS) ** 2)
    while tiles * segments < wanted and not (tile_rows and segment_rows):
        if not tile_rows and (segment_rows or queries * segments >= items * tiles):
            tiles += 1
        else:
            segments += 1
    return tiles, segments


def blank(kind: T.DataType):
    """A value for the key column of the other side; never NULL, which would turn integers into floats in pandas."""
    return F.lit(0 if isinstance(kind, T.NumericType) else "").cast(kind)


class _Running:
    """Best k items per query of one tile while items arrive in key order."""

    def __init__(self, unit, k: int, skip_same: bool, min_score: float | None):
        self.unit, self.k, self.skip_same, self.min_score = unit, k, skip_same, min_score
        self.head: list[pd.DataFrame] = []
        self.q = None

    def add(self, pdf: pd.DataFrame) -> None:
        asks = pdf["_side"].to_numpy() == 0
        if asks.any():
            self.head.append(pdf[asks])
        got = pdf[~asks]
        if not len(got) or not self.head:
            return
        if self.q is None:
            q = pd.concat(self.head)
            self.q, self.block, self.vec = q["_qk"].to_numpy(), q["_b"].to_numpy(), matrix(q["_v"])
            self.none = q["_v"].isna().all()  # no vector, no width: nothing to multiply
            self.norm = np.sqrt((self.vec * self.vec).sum(1))
            self.norm[self.norm == 0] = np.nan
            self.score = np.full((len(q), self.k), -np.inf)
            self.item = np.zeros(self.score.shape, dtype=got["_ik"].to_numpy().dtype)
        rows = max(64, min(2048, TILE_VALUES // len(self.q)))
        for lo in range(0, len(got), rows):
            self._merge(got.iloc[lo : lo + rows])

    def _merge(self, got: pd.DataFrame) -> None:
        if self.none or got["_v"].isna().all():
            return
        b = matrix(got["_v"])
        norm = np.sqrt((b * b).sum(1))
        norm[norm == 0] = np.nan
        raw = self.vec @ b.T
        raw /= self.norm[:, None]
        raw /= norm[None, :]
        # Rounding moves a score by less than this, so what stays behind a query's last kept one needs no further look.
        least = self.score[:, -1] if self.min_score is None else np.maximum(self.score[:, -1], self.min_score)
        row, col = np.nonzero(raw > (least - 1e-6)[:, None])
        ids, block = got["_ik"].to_numpy(), got["_b"].to_numpy()
        able = self.block[row] != block[col]
        if self.skip_same:
            able &= (self.q[row] != ids[col]).astype(bool)
        row, col = row[able], col[able]
        # The shift sends exact halves one way whatever the summation order was.
        c = np.round(np.round(raw[row, col], DIGITS) + 1e-10, 6)
        # Items come in key order, so one that only equals a query's last kept score stays behind it.
        ahead = c > self.score[row, -1]
        if self.min_score is not None:
            ahead &= c >= self.min_score
        row, col, c = row[ahead], col[ahead], c[ahead]
        if not len(row):
            return
        if len(row) > self.score.size:
            full = np.full(raw.shape, -np.inf)
            full[row, col] = c
            row, col = best_columns(full, self.k)
            c = full[row, col]
        some, at = np.unique(row, return_inverse=True)
        old = np.repeat(np.arange(len(some)), self.k)
        score = np.concatenate([self.score[some].ravel(), c])
        item = np.concatenate([self.item[some].ravel(), ids[col]])
        where = np.concatenate([old, at])
        order = np.lexsort((-score, where))  # stable: equal scores stay in key order
        where = where[order]
        first = order[np.arange(len(where)) - np.searchsorted(where, where) < self.k]
        self.score[some], self.item[some] = score[first].reshape(-1, self.k), item[first].reshape(-1, self.k)

    def result(self, names: list[str]) -> pd.DataFrame:
        row, col = np.nonzero(self.score > -np.inf)
        return pd.DataFrame(dict(zip(names, (self.q[row], self.item[row, col], self.score[row, col]))))
