"""URL filters: host and path rules looked up in a cascade of Bloom filters that is exact for the corpus's own keys.

A rule is a key: host, a slash, the path prefix. A URL has a few candidate keys: each suffix of its host with each
prefix of its path that is as long as some rule's path. The distinct candidate keys of all pages are the key
universe. Level one encodes the listed keys; the universe keys that it lets through by mistake go into level two,
the listed keys that level two holds by mistake into level three, and so on until a level makes no mistake. A key
of the universe is listed if the first level that rejects it has an odd distance from the start, so the lookup needs
no join and no list, and is exact. With r listed keys and s others level one takes about r * log2(s / r) bits: its
error rate is set so that about r keys pass by mistake, and those are what the driver sees.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from peerlens.llm.common import aside, batches, table

#: (host, path prefix, verdict). A rule fits its host and all subdomains; the longest host and path win.
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


class Bloom:
    """Bits of one level; the level number salts the hash, so that levels err independently."""

    def __init__(self, keys: Sequence[bytes], rate: float, level: int):
        n = max(1, len(keys))
        self.size = max(8, math.ceil(-n * math.log(rate) / math.log(2) ** 2))
        self.hashes = max(1, round(self.size / n * math.log(2)))
        self.level = level
        self.bits = np.zeros((self.size + 7) // 8, np.uint8)
        for key in keys:
            for at in self._places(key):
                self.bits[at >> 3] |= 1 << (at & 7)

    def _places(self, key: bytes) -> list[int]:
        h = xxhash.xxh3_128_intdigest(key, self.level)
        a, b = h & (1 << 64) - 1, h >> 64 | 1
        return [(a + i * b) % self.size for i in range(self.hashes)]

    def __contains__(self, key: bytes) -> bool:
        return all(self.bits[at >> 3] >> (at & 7) & 1 for at in self._places(key))


def holds(cascade: Sequence[Bloom], key: bytes) -> bool:
    """Exact for keys of the universe: the level that rejects the key decides."""
    for at, level in enumerate(cascade):
        if key not in level:
            return at % 2 == 1
    return len(cascade) % 2 == 1


def candidate_keys(host: str, path: str, lengths: Iterable[int]) -> list[bytes]:
    """All keys under which a rule for this URL could be listed, the winning order first: longest host, then longest path.

    Wins means longest: hosts of the candidates are suffixes of one host and paths prefixes of one path, and a key is
    as long as both together, so the candidates are ordered by total length, then by host.
    """
    if not host:
        return []
    labels = host.split(".")
    hosts = [".".join(labels[i:]) for i in range(len(labels))]
    found = [(len(h) + n, len(h), f"{h}{path[:n]}".encode()) for h in hosts if h for n in lengths if n <= len(path)]
    return [key for _, _, key in sorted(found, reverse=True)]


def cascade_of(rules: Sequence[tuple[str, str, str]], universe: DataFrame) -> list[Bloom]:
    """Levels that are exact for every key of ``universe`` (column key). Only the mistakes of level one, about as many as the rules, are collected."""
    listed = sorted({f"{h}{p}".encode() for h, p, _ in rules})
    others = max(1, universe.count())
    rate = min(0.5, max(1e-9, 0.7 * len(listed) / others))
    levels = [Bloom(listed, rate, 0)]
    first, inside = levels[0], set(listed)

    def mistakes(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.record_batch([pa.array([k for k in batch.column(0).to_pylist() if k in first and k not in inside], pa.binary())], ["key"])

    encode, other = [bytes(r["key"]) for r in batches(universe, mistakes, "key binary").toLocalIterator()], listed
    while encode:
        levels.append(Bloom(encode, 0.5, len(levels)))
        encode, other = [k for k in other if k in levels[-1]], encode
    return levels


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict), one row per input row.

    Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; path: from there up to ``?``,
    ``#`` or the end. A null URL or one without ``://`` has both empty, fits no rule and gets ``default``, as any page
    without a rule. Of two rules of the same length the one with the longer host wins; a rule listed twice takes its
    first verdict. Repeated rows are judged each; other columns are not read.
    """
    if any(len(f"{h}{p}") != len(f"{h}{p}".encode()) for h, p, _ in rules) or any(not p.startswith("/") for _, p, _ in rules):
        raise ValueError("rules are ASCII and their paths begin with a slash")
    lengths = sorted({len(p) for _, p, _ in rules}, reverse=True)
    read = pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))

    def keys(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = {k for h, p in set(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)) for k in candidate_keys(h, p, lengths)}
        return pa.record_batch([pa.array(sorted(found), pa.binary())], ["key"])

    universe = aside(batches(read.select("host", F.substring("path", 1, max(lengths, default=0)).alias("path")), keys, "key binary").distinct(), "url-keys")
    levels = cascade_of(rules, universe)
    # The verdict of a listed key: a table of the rules themselves, read only for keys that the cascade has admitted.
    verdicts: dict[bytes, str] = {}
    for h, p, v in rules:
        verdicts.setdefault(f"{h}{p}".encode(), v)

    def decide(batch: pa.RecordBatch) -> pa.RecordBatch:
        rule, verdict = [], []
        known: dict[bytes, bool] = {}
        for h, p in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            hit = None
            for key in candidate_keys(h, p, lengths):
                if key not in known:
                    known[key] = holds(levels, key)
                if known[key]:
                    hit = key
                    break
            rule.append(hit and hit.decode())
            verdict.append(verdicts[hit] if hit else default)
        return pa.record_batch([*batch.columns, pa.array(rule, pa.string()), pa.array(verdict, pa.string())], ["page_id", "host", "path", "rule", "verdict"])

    kind = read.schema["page_id"].dataType.simpleString()
    return batches(read, decide, f"page_id {kind}, host string, path string, rule string, verdict string")


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))


QUERIES = {"op9_url_filters": op9_url_filters}
SQL = {
    "op9_url_filters": r"""
WITH u AS (SELECT page_id, lower(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1)) AS host, regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
rules(h, p, v) AS (VALUES """
    + ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
    + """),
hit AS (SELECT page_id, host, path, h || p AS rule, v FROM u JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)),
best AS (SELECT page_id, max_by(rule, length(rule)) AS rule, max_by(v, length(rule)) AS v FROM hit GROUP BY page_id)
SELECT u.page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM u LEFT JOIN best USING (page_id)
"""
}
