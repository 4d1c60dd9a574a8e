"""Pairwise work inside groups without ever producing pair rows.

A group of n rows is cut into ceil(n / tile_rows) hash tiles. Every unordered pair of tiles is one
bounded unit of work: two blocks of rows go in, one matrix product is formed, and only per-row
partial results (sums, counts, best k, runs of equal values) come out and are merged by a groupBy.
A hot group becomes many independent tile pairs; a small group is one unit.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from peerlens.operators.grouped import as_list, grouped_map, with_group_stats
from peerlens.runtime import pin

TILE_ROWS = 2048
DIGITS = 12


def tiled(rows: DataFrame, group: str, key, *, tile_rows: int = TILE_ROWS) -> DataFrame:
    """Add the group size ``_n``, the number of tiles ``_nt`` and the row's tile ``_tile``."""
    keys = as_list(key)
    return (
        with_group_stats(rows, group, keys, [])
        .withColumn("_nt", F.ceil(F.col("_n") / F.lit(tile_rows)).cast("int"))
        .withColumn("_tile", F.pmod(F.xxhash64(*keys), F.col("_nt")).cast("int"))
    )


def tile_map(
    tiles: DataFrame,
    group: str,
    key,
    columns: Sequence[str],
    fn: Callable[[pd.DataFrame, pd.DataFrame, bool], Sequence],
    out: Sequence[T.StructField],
) -> DataFrame:
    """Run ``fn(own, other, same)`` for both directions of every tile pair of every group.

    ``fn`` returns one column per field of ``out``, one entry per row of ``own``; the key columns
    are added in front. Rows inside a tile are ordered by key, so repeated passes see equal matrices.
    """
    keys = as_list(key)
    other = F.explode(F.sequence(F.lit(0), F.col("_nt") - 1))
    paired = (
        tiles.select(group, *keys, "_n", "_nt", "_tile", *columns)
        .withColumn("_o", other)
        .withColumn("_ta", F.least("_tile", "_o"))
        .withColumn("_tb", F.greatest("_tile", "_o"))
        .drop("_o")
    )
    fields = [tiles.schema[c] for c in [group, *keys]] + list(out)

    def run(unit: tuple, pdf: pd.DataFrame):
        if unit[1] == unit[2]:
            sides = [(pdf, pdf, True)]
        else:
            first = pdf["_tile"].to_numpy() == unit[1]
            a, b = pdf[first], pdf[~first]
            if not len(a) or not len(b):
                return None
            sides = [(a, b, False), (b, a, False)]
        parts = []
        for own, oth, same in sides:
            head = [own[c].tolist() for c in [group, *keys]]
            parts.append(head + [list(c) for c in fn(own, oth, same)])
        return [sum(cols, []) for cols in zip(*parts)]

    return grouped_map(paired, [group, "_ta", "_tb"], run, T.StructType(fields), order=["_tile", *keys])


# ---- pair measures -------------------------------------------------------------------------------


def matrix(col: pd.Series) -> np.ndarray:
    """Rows of vectors; a NULL vector is a row of NaN, so that all its measures are NaN: it has no partner."""
    values = col.to_numpy()
    width = next((len(v) for v in values if v is not None), 1)
    none = np.full(width, np.nan)
    return np.stack([none if v is None else np.asarray(v, dtype=np.float64) for v in values])


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines, NaN where a norm is zero."""
    na, nb = np.sqrt((a * a).sum(1)), np.sqrt((b * b).sum(1))
    na[na == 0], nb[nb == 0] = np.nan, np.nan
    c = a @ b.T
    c /= na[:, None]
    c /= nb[None, :]
    return np.round(c, DIGITS, out=c)


def euclidean(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances rounded to 9 digits; pairs too close for the product form are recomputed directly."""
    sa, sb = (a * a).sum(1), (b * b).sum(1)
    sq, both = a @ b.T, sa[:, None] + sb[None, :]
    sq *= 2.0
    np.subtract(both, sq, out=sq)
    both *= 1e-3
    i, j = np.nonzero(sq < both)
    for lo in range(0, len(i), 65536):
        p, q = i[lo : lo + 65536], j[lo : lo + 65536]
        sq[p, q] = ((a[p] - b[q]) ** 2).sum(1)
    np.maximum(sq, 0.0, out=sq)
    np.sqrt(sq, out=sq)
    return np.round(sq, 9, out=sq)


def cosine_distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.round(1.0 - cosine(a, b), 9)


MEASURES = {"cos": cosine, "euclid": euclidean, "cosdist": cosine_distance}


def pair_values(own: pd.DataFrame, oth: pd.DataFrame, same: bool, vec: str, measure: str, diagonal) -> np.ndarray:
    """Measure matrix of two blocks; the diagonal of a block with itself is set to ``diagonal`` (NaN = left out)."""
    a = matrix(own[vec])
    c = MEASURES[measure](a, a if same else matrix(oth[vec]))
    if same and diagonal != "keep":
        np.fill_diagonal(c, np.nan if diagonal is None else diagonal)
    return c


# ---- mergeable reductions ------------------------------------------------------------------------

_D, _L, _I = T.DoubleType(), T.LongType(), T.IntegerType()


def _clean(x: np.ndarray) -> list:
    return [None if v != v else float(v) for v in x]


def pair_moments(
    tiles: DataFrame, group: str, key: str, vec: str, *, measure: str = "cos", diagonal=0.0, ranks: dict | None = None
) -> DataFrame:
    """Per row: number, sum, sum of squares, smallest and largest measure to its group.

    ``ranks`` maps a name to a quantile in 0..1. Groups of one tile get their quantiles here as
    columns of that name; the others hold NULL there and are finished by ``pair_quantiles``.
    """
    ranks = ranks or {}

    def reduce(own, oth, same):
        c = pair_values(own, oth, same, vec, measure, diagonal)
        gaps = np.isnan(c)
        n = c.shape[1] - gaps.sum(1)
        if gaps.any():
            lo, hi = np.where(gaps, np.inf, c).min(1), np.where(gaps, -np.inf, c).max(1)
            lo, hi = np.where(n > 0, lo, np.nan), np.where(n > 0, hi, np.nan)
            z = np.where(gaps, 0.0, c)
        else:
            lo, hi, z = c.min(1), c.max(1), c
        cols = [n.tolist(), z.sum(1).tolist(), np.einsum("ij,ij->i", z, z).tolist(), _clean(lo), _clean(hi)]
        if ranks:
            if own["_nt"].iat[0] == 1:
                s = np.sort(c, axis=1)
                for q in ranks.values():
                    cols.append(_clean(_interpolate(s, n, q)))
            else:
                cols += [[None] * len(own)] * len(ranks)
        return cols

    fields = [
        T.StructField(f, t)
        for f, t in [("_cnt", _L), ("_sum", _D), ("_ssq", _D), ("_min", _D), ("_max", _D)] + [(r, _D) for r in ranks]
    ]
    parts = tile_map(tiles, group, key, [vec], reduce, fields)
    return parts.groupBy(group, key).agg(
        F.sum("_cnt").alias("_cnt"),
        F.sum("_sum").alias("_sum"),
        F.sum("_ssq").alias("_ssq"),
        F.min("_min").alias("_min"),
        F.max("_max").alias("_max"),
        *[F.max(r).alias(r) for r in ranks],
    )


def _interpolate(s: np.ndarray, n: np.ndarray, q: float) -> np.ndarray:
    at = q * np.maximum(n - 1, 0)
    lo, hi = np.floor(at).astype(int), np.ceil(at).astype(int)
    r = np.arange(len(s))
    low, high = s[r, lo], s[r, hi]
    return low + (high - low) * (at - lo)


def order_values(
    tiles: DataFrame,
    group: str,
    key: str,
    vec: str,
    state: DataFrame,
    targets: dict[str, Column],
    *,
    measure: str,
    diagonal,
    block_rows: int = 1024,
) -> DataFrame:
    """Exact order statistics of each row's measures to its group, for groups of many tiles.

    ``state`` has one row per (group, key) with ``_cnt``, ``_min``, ``_max``; ``targets`` maps a name
    to a 0-based rank expression over it. In a round a task unit holds one tile and sees all rows of the group
    once, block by block. A row's rank is known to lie in an interval; the unit counts the values in
    equal parts of the interval (equal in the order of the doubles' bits), and the part that holds the rank, cut to the values found in it, is the
    next round's interval. An interval with no more than ``_Selection.HELD`` values is read out. Parts divide
    the 64 bits, so however concentrated the values are, eight rounds narrow any interval to one value;
    evenly spread values take two. What a unit holds follows from the tile, the parts and ``HELD`` alone.
    """
    names = list(targets)
    base = pin(tiles.select(group, key, "_nt", "_tile", vec), "order-tiles")
    rank = F.array(*[targets[t].cast("long") for t in names])
    # The bounds come from other products than the rounds' own, so they get some air.
    ends = {"_lo": F.col("_min") - F.lit(1e-8), "_hi": F.col("_max") + F.lit(1e-8)}
    waiting = state.select(
        group, key, rank.alias("_rank"), *[F.array_repeat(e, len(names)).alias(n) for n, e in ends.items()],
        F.transform(rank, lambda r: F.when(r.isNotNull(), F.col("_cnt")).otherwise(0)).alias("_left"),
        F.array_repeat(F.lit(None).cast("double"), len(names)).alias("_found"),
    )
    longs, doubles = T.ArrayType(_L), T.ArrayType(_D)
    kept = {"_rank": longs, "_lo": doubles, "_hi": doubles, "_left": longs, "_found": doubles}
    out = T.StructType([tiles.schema[group], tiles.schema[key], *[T.StructField(n, k) for n, k in kept.items()], T.StructField("_more", T.BooleanType())])

    def run(batches):
        unit = None
        for pdf in batches:
            if not len(pdf):
                continue
            g, u = pdf[group].to_numpy(), pdf["_u"].to_numpy()
            cuts = np.flatnonzero((g[1:] != g[:-1]) | (u[1:] != u[:-1])) + 1
            for part in np.split(np.arange(len(pdf)), cuts):
                name = (g[part[0]], u[part[0]])
                if unit is None or unit.name != name:
                    if unit is not None:
                        yield unit.result(group, key)
                    unit = _Selection(name, key, vec, list(kept), measure, diagonal, block_rows)
                unit.add(pdf.iloc[part])
        if unit is not None:
            yield unit.result(group, key)

    tasks = int(tiles.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    done = None
    while True:
        head = base.join(waiting, [group, key]).withColumn("_u", F.col("_tile")).withColumn("_side", F.lit(0))
        units = head.select(group, "_u").distinct()
        body = base.withColumn("_u", F.explode(F.sequence(F.lit(0), F.col("_nt") - 1))).join(units, [group, "_u"], "left_semi")
        body = body.withColumn("_side", F.lit(1)).withColumns({n: F.lit(None).cast(k) for n, k in kept.items()})
        ready = head.unionByName(body).repartition(tasks, group, "_u").sortWithinPartitions(group, "_u", "_side", key)
        seen = pin(ready.mapInPandas(run, out), "order-round")
        ended = seen.where(~F.col("_more")).select(group, key, *[F.col("_found")[i].alias(t) for i, t in enumerate(names)])
        done = ended if done is None else done.unionByName(ended)
        # The rows of a unit go on together, so that every round forms the same products.
        waiting = seen.where("_more").drop("_more")
        if waiting.isEmpty():
            return done


def _order_key(x: np.ndarray) -> np.ndarray:
    """Whole numbers in the order of the doubles."""
    bits = (np.asarray(x, np.float64) + 0.0).view(np.int64)
    flip = bits >> 63  # all ones below zero
    flip &= np.int64(0x7FFF_FFFF_FFFF_FFFF)
    bits ^= flip
    return bits


def _from_key(k: np.ndarray) -> np.ndarray:
    """The doubles of such whole numbers."""
    return np.where(k < 0, k ^ np.int64(0x7FFF_FFFF_FFFF_FFFF), k).view(np.float64)


class _Selection:
    """One round of narrowing between one tile and a group that streams past it."""

    #: Parts of an interval, of which at least half are used, and values that are read out instead of narrowed.
    PARTS, HELD = 512, 256

    def __init__(self, name, key: str, vec: str, columns: list[str], measure: str, diagonal, block_rows: int):
        self.name, self.key, self.vec, self.columns = name, key, vec, columns
        self.measure, self.diagonal, self.block_rows = measure, diagonal, block_rows
        self.head: list[pd.DataFrame] = []
        self.held: list[pd.DataFrame] = []
        self.waiting, self.a = 0, None

    def add(self, pdf: pd.DataFrame) -> None:
        side = pdf["_side"].to_numpy()
        if (side == 0).any():
            self.head.append(pdf[side == 0])
        part = pdf[side == 1]
        if not len(part):
            return
        if self.a is None:
            self._enter()
        self.held.append(part)
        self.waiting += len(part)
        if self.waiting >= self.block_rows:
            self._flush(whole=True)

    def _flush(self, whole: bool = False) -> None:
        """Work on the rows that wait, in blocks of a fixed size, so that each round forms the same products."""
        if not self.waiting:
            return
        rows = pd.concat(self.held)
        end = len(rows) - len(rows) % self.block_rows if whole else len(rows)
        for lo in range(0, end, self.block_rows):
            self._block(rows.iloc[lo : min(end, lo + self.block_rows)])
        self.held, self.waiting = [rows.iloc[end:]], len(rows) - end

    def _enter(self) -> None:
        own = pd.concat(self.head)
        self.keys, self.a = own[self.key].to_numpy(), matrix(own[self.vec])
        stacked = {c: np.stack([np.array([np.nan if x is None else x for x in v], float) for v in own[c]]) for c in self.columns}
        self.rank, self.left = (np.nan_to_num(stacked[c], nan=0).astype(np.int64) for c in ("_rank", "_left"))
        self.asked, self.found = ~np.isnan(stacked["_rank"]), stacked["_found"]
        self.low, self.high = (_order_key(np.nan_to_num(stacked[c], nan=0)) for c in ("_lo", "_hi"))
        n, targets = self.left.shape
        # Targets that ask all rows about the same intervals are counted once.
        self.same = [next(u for u in range(t + 1) if (self.low[:, u] == self.low[:, t]).all() and (self.high[:, u] == self.high[:, t]).all() and (self.left[:, u] == self.left[:, t]).all()) for t in range(targets)]
        narrow = self.left > self.HELD
        self.reads = (self.left > 0) & ~narrow
        self.narrows = narrow
        width = (self.high - self.low).view(np.uint64)  # right modulo 2**64 whatever the signs
        # Parts are powers of two long, so a value's part is a shift: the smallest shift that leaves fewer than PARTS.
        bits = np.uint64(self.PARTS.bit_length() - 1)
        self.shift = np.zeros(width.shape, np.uint64)
        for half in (32, 16, 8, 4, 2, 1):
            more = (width >> self.shift >> np.uint64(half - 1) >> bits) > 0
            self.shift[more] += np.uint64(half)
        # A row that asks nothing has an empty interval.
        empty = self.left <= 0
        self.floor = np.where(empty, np.inf, _from_key(self.low))
        self.ceiling = np.where(empty, -np.inf, _from_key(self.high))
        self.count = {t: np.zeros((n, self.PARTS), np.int64) for t in set(self.same) if narrow[:, t].any()}
        self.least = {t: np.full((n, self.PARTS), np.inf) for t in self.count}
        self.most = {t: np.full((n, self.PARTS), -np.inf) for t in self.count}
        self.values: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {t: [] for t in set(self.same)}

    def _block(self, rows: pd.DataFrame) -> None:
        c = MEASURES[self.measure](self.a, matrix(rows[self.vec]))
        if self.diagonal != "keep":
            # A row meets itself only in its own tile.
            mine = np.flatnonzero(rows["_tile"].to_numpy() == self.name[1])
            same = self.keys[:, None] == rows[self.key].to_numpy()[mine][None, :]
            i, j = np.nonzero(same)
            c[i, mine[j]] = np.nan if self.diagonal is None else self.diagonal
        for t in self.values:
            inside = c >= self.floor[:, t : t + 1]
            inside &= c <= self.ceiling[:, t : t + 1]
            at = np.flatnonzero(inside)
            if not len(at):
                continue
            times = np.count_nonzero(inside, axis=1)
            value = c.ravel()[at] if len(at) < c.size else c.ravel()
            if self.reads[:, t].any():
                reads = np.repeat(self.reads[:, t], times)
                self.values[t].append((np.repeat(np.arange(len(c)), times)[reads], value[reads]))
                value, times = value[~reads], np.where(self.reads[:, t], 0, times)
            if t in self.count and len(value):
                part = _order_key(value)
                part -= np.repeat(self.low[:, t], times)
                at = (part.view(np.uint64) >> np.repeat(self.shift[:, t], times)).view(np.int64)
                at += np.repeat(np.arange(len(c)) * self.PARTS, times)
                self.count[t] += np.bincount(at, minlength=self.count[t].size).reshape(self.count[t].shape)
                np.minimum.at(self.least[t].reshape(-1), at, value)
                np.maximum.at(self.most[t].reshape(-1), at, value)

    def result(self, group: str, key: str) -> pd.DataFrame:
        if self.a is None:
            self._enter()
        self._flush()
        rank, left = self.rank.copy(), np.zeros_like(self.left)
        low, high = np.zeros(left.shape), np.zeros(left.shape)
        for t, u in enumerate(self.same):
            if self.values[u]:
                row, value = (np.concatenate(x) for x in zip(*self.values[u]))
                order = np.lexsort((value, row))
                row, value = row[order], value[order]
                start, stop = np.searchsorted(row, np.arange(len(self.a))), np.searchsorted(row, np.arange(len(self.a)), "right")
                some = self.reads[:, t] & self.asked[:, t] & (stop > start)
                self.found[some, t] = value[np.minimum(start + rank[:, t], stop - 1)[some]]
            if u in self.count:
                some = np.flatnonzero(self.narrows[:, t])
                upto = self.count[u][some].cumsum(axis=1)
                at = np.minimum((upto <= rank[some, t][:, None]).sum(axis=1), self.PARTS - 1)
                inside = self.count[u][some, at]
                rank[some, t] -= upto[np.arange(len(some)), at] - inside
                low[some, t], high[some, t], left[some, t] = self.least[u][some, at], self.most[u][some, at], inside
                equal = some[(low[some, t] == high[some, t])]
                self.found[equal, t], left[equal, t] = low[equal, t], 0
        lists = {"_rank": rank, "_lo": low, "_hi": high, "_left": left}
        more = bool((left > 0).any())
        found = [[None if x != x else float(x) for x in r] for r in self.found]
        ranks = [[int(x) if a else None for x, a in zip(r, asked)] for r, asked in zip(rank, self.asked)]
        return pd.DataFrame({group: [self.name[0]] * len(self.a), key: self.keys, **{n: v.tolist() for n, v in lists.items()}, "_rank": ranks, "_found": found, "_more": [more] * len(self.a)})


def pair_quantiles(
    tiles: DataFrame, group: str, key: str, vec: str, moments: DataFrame, quantiles: dict[str, float], **how
) -> DataFrame:
    """Fill the quantile columns of ``moments`` for groups of several tiles (exact, linear-interpolated)."""
    big = tiles.where(F.col("_nt") > 1)
    if not big.select(F.lit(1)).limit(1).count():
        return moments
    state = moments.join(big.select(group, key), [group, key])
    targets = {}
    for name, q in quantiles.items():
        at = F.lit(q) * (F.col("_cnt") - 1)
        targets[f"{name}_a"], targets[f"{name}_b"] = F.floor(at), F.ceil(at)
    found = order_values(big, group, key, vec, state, targets, **how)
    out = moments.join(found, [group, key], "left")
    for name, q in quantiles.items():
        at = F.lit(q) * (F.col("_cnt") - 1)
        a, b = F.col(f"{name}_a"), F.col(f"{name}_b")
        out = out.withColumn(name, F.coalesce(F.col(name), a + (b - a) * (at - F.floor(at))))
    return out.drop(*targets)
