"""Personal data by weak supervision: labelers vote on candidate spans, expectation-maximisation weighs the labelers, a classifier decides.

Four kinds have a fixed definition (email, ip, card, phone) and are always reported. Further candidates come from
loose patterns: secrets, identity numbers, names, local phone numbers, IPv6 addresses. Labelers (strict pattern,
gazetteer, context before, shape, other reading) vote yes, no or abstain on every candidate, the fixed kinds included. The
counts of all vote patterns of the corpus, a table whose size is bounded by the number of patterns, go to the driver;
a two-class latent model is fitted to them, and its posteriors train a logistic classifier over votes and span
features, which decides on the further candidates. Texts are read twice: for the counts and for the spans.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peerlens.llm.common import streams, table

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "secret", "id", "name", "localphone", "ipv6")
LABELERS = 5
#: Gazetteers: prefixes of access keys, titles, given names.
KEY_PREFIXES = ("AKIA", "ASIA", "ghp_", "gho_", "github_pat_", "xoxb-", "xoxp-", "sk-", "sk_live_", "glpat-", "AIza", "eyJ")
GIVEN_NAMES = frozenset("anna james john linda maria mary michael patricia peter robert thomas william".split())
TITLES = ("Mr", "Mrs", "Ms", "Dr", "Prof", "Herr", "Frau", "Monsieur", "Madame")

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
# A look-behind changes nothing (a match never starts inside a run of digits) but spares a retry at each digit.
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_ASSIGNED = re.compile(r"(?i:passw(?:or)?d|pwd|secret|token|api[_-]?key|access[_-]?key|auth)[\x20\t]{0,3}[:=][\x20\t]{0,3}[\"']?([^\s\"'<>]{6,})")
_TOKEN = re.compile(r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{16,}(?![A-Za-z0-9_-])")
_ID = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])|(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?![A-Za-z0-9])")
_NAME = re.compile(r"(?<![A-Za-z])(?:(?:" + "|".join(TITLES) + r")\.?|(?i:my name is|i am called))\x20([A-Z][a-z]{1,30}(?:\x20[A-Z][a-z]{1,30})?)")
_LOCALPHONE = re.compile(r"(?<![0-9+(])\([0-9]{2,4}\)\x20?[0-9]{3}[\x20-][0-9]{4}(?![0-9])")
_IPV6 = re.compile(r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])")
_FOR = re.compile(r"(?i)passw|pwd|secret|token|key|auth|credential|ssn|social|iban|account|passport|name|call|phone|tel|contact|mail|card|visa|\bip\b|host")
_AGAINST = re.compile(r"(?i)commit|sha-?[0-9]|md5|checksum|version|isbn|hash|example|build|order")

Span = tuple[str, int, int]


def emails(text: str) -> list[Span]:
    """Leftmost, not overlapping: from the first local character reachable before an @, to the end of the domain."""
    found, free, at = [], 0, text.find("@")
    while at >= 0:
        domain = _DOMAIN.match(text, at)
        start = at
        if domain:
            # The run of local characters before the @, not beyond the previous address; read backwards in steps.
            step = 64
            while True:
                low = max(free, at - step)
                run = _LOCAL.search(text, low, at)
                start = run.start() if run else at
                if start > low or low == free:
                    break
                step *= 4
        if domain and start < at:
            found.append(("email", start, domain.end()))
            free = domain.end()
            at = text.find("@", free)
        else:
            at = text.find("@", at + 1)
    return found


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """The spans of the four fixed kinds, by kind, then start."""
    found = emails(text)
    if _DIGIT.search(text):
        found += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.group().split("."))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 16:
                digits = m.group().replace(" ", "").replace("-", "")
                if 16 <= len(digits) <= 19 and luhn(digits):
                    found.append(("card", m.start(), m.end()))
        if "+" in text:
            found += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m.group()) <= 15]
    return found


def _further(text: str) -> list[Span]:
    found = [("secret", m.start(1), m.end(1)) for m in _ASSIGNED.finditer(text)]
    found += [("secret", m.start(), m.end()) for m in _TOKEN.finditer(text) if _DIGIT.search(m.group()) and re.search("[A-Za-z]", m.group())]
    found += [("name", m.start(1), m.end(1)) for m in _NAME.finditer(text)]
    if _DIGIT.search(text):
        found += [("id", m.start(), m.end()) for m in _ID.finditer(text)]
        found += [("localphone", m.start(), m.end()) for m in _LOCALPHONE.finditer(text)]
        found += [("ipv6", m.start(), m.end()) for m in _IPV6.finditer(text)]
    return found


def entropy(value: str) -> float:
    return -sum(n / len(value) * math.log2(n / len(value)) for n in Counter(value).values())


def votes(text: str, span: Span) -> tuple[int, ...]:
    """One vote per labeler: 1 personal data, -1 not, 0 no opinion."""
    kind, start, end = span
    value = text[start:end]
    digits, letters = sum(c.isdigit() for c in value), sum(c.isalpha() for c in value)
    if kind in BASE:
        pattern = 1
    elif kind == "secret":
        pattern = 1 if re.fullmatch(r"(?:AKIA|ASIA)[A-Z0-9]{16}|[0-9a-f]{16,64}|(?:gh[po]_|sk-|xox[bp]-|glpat-)[A-Za-z0-9_-]{16,}", value) else 0
    elif kind == "id":
        pattern = 1 if not value.startswith(("000", "666", "9")) else -1
    else:
        pattern = 0
    if kind == "secret":
        gazetteer = 1 if value.startswith(KEY_PREFIXES) else 0
    elif kind == "name":
        gazetteer = 1 if value.split(" ")[0].lower() in GIVEN_NAMES else 0
    else:
        gazetteer = 0
    before = text[max(0, start - 40) : start]
    context = 1 if _FOR.search(before) else -1 if _AGAINST.search(before) else 0
    if kind == "secret":
        shape = 1 if len(value) >= 12 and digits >= 3 and letters >= 1 and entropy(value) >= 2.8 else -1 if digits == 0 or entropy(value) < 2.2 else 0
    elif kind == "name":
        shape = 1 if " " in value else 0
    else:
        shape = 1 if digits >= 8 or kind == "email" else 0
    # Another reading of the value speaks against it: words, one repeated sign, dates.
    other = -1 if re.fullmatch(r"[a-z]+[.,;]?|(.)\1*|[0-9]{4}-[0-9]{2}-[0-9]{2}.*|[A-Za-z]+(?:[-_][A-Za-z]+)*[0-9]{0,2}", value) and kind != "name" else 0
    return pattern, gazetteer, context, shape, other


def pattern_of(text: str, span: Span) -> str:
    """What the models know of a span: its kind, its votes, its length class."""
    return f"{KINDS.index(span[0])}|{','.join(map(str, votes(text, span)))}|{min(4, (span[2] - span[1]) // 12)}"


def candidates(text: str) -> tuple[list[Span], list[Span]]:
    """Fixed spans, and further ones: none overlaps a fixed one or another, the earlier and then the longer one stays."""
    fixed = base_spans(text)
    taken = sorted((s, e) for _, s, e in fixed)
    ends: list[int] = []
    for _, e in taken:
        ends.append(max(e, ends[-1] if ends else 0))
    starts = [s for s, _ in taken]
    further, last = [], -1
    for kind, s, e in sorted(_further(text), key=lambda x: (x[1], -x[2], KINDS.index(x[0]))):
        at = int(np.searchsorted(starts, e)) if starts else 0
        if s >= last and not (at and ends[at - 1] > s):
            further.append((kind, s, e))
            last = e
    return fixed, further


@dataclass
class Model:
    """``weights``: of the span classifier; ``reliabilities``: of the labelers, labeler x (yes, no) x vote."""

    weights: np.ndarray
    reliabilities: np.ndarray

    def probability(self, pattern: str) -> float:
        return float(1 / (1 + math.exp(-max(-50.0, min(50.0, float(_features(pattern) @ self.weights))))))


def _parts(pattern: str) -> tuple[int, list[int], int]:
    kind, vote, size = pattern.split("|")
    return int(kind), [int(v) for v in vote.split(",")], int(size)


def _features(pattern: str) -> np.ndarray:
    kind, vote, size = _parts(pattern)
    x = np.zeros(1 + len(KINDS) + 2 * LABELERS + 5)
    x[0] = 1
    x[1 + kind] = 1
    for i, v in enumerate(vote):
        if v:
            x[1 + len(KINDS) + 2 * i + (v < 0)] = 1
    x[1 + len(KINDS) + 2 * LABELERS + size] = 1
    return x


def fit(counts: dict[str, int], rounds: int = 50, prior: float = 0.5) -> Model:
    """Expectation-maximisation over vote patterns, then logistic regression on the posteriors.

    Reliabilities start from labelers that are right four times in five and are smoothed by ten such votes, so that a
    labeler keeps its sense on small corpora and without any candidate.
    """
    patterns = sorted(counts)
    n = np.array([counts[p] for p in patterns], float)
    vote = np.array([_parts(p)[1] for p in patterns], int).reshape(-1, LABELERS) + 1
    start = np.array([[[0.10, 0.30, 0.60], [0.60, 0.30, 0.10]]] * LABELERS)  # labeler x (yes, no) x vote (-1, 0, 1)
    rely, share = start.copy(), prior
    post = np.zeros(len(patterns))
    for _ in range(rounds if patterns else 0):
        logs = np.log(rely[np.arange(LABELERS)[None, :], :, vote])  # pattern x labeler x class
        both = logs.sum(axis=1) + np.log([share, 1 - share])
        post = 1 / (1 + np.exp(np.clip(both[:, 1] - both[:, 0], -50, 50)))
        for k, w in enumerate((n * post, n * (1 - post))):
            for i in range(LABELERS):
                seen = np.bincount(vote[:, i], weights=w, minlength=3) + 10 * start[i, k]
                rely[i, k] = seen / seen.sum()
        share = float(np.clip((n @ post + 1) / (n.sum() + 2), 0.05, 0.95))
    width = 1 + len(KINDS) + 2 * LABELERS + 5
    x = np.array([_features(p) for p in patterns]).reshape(len(patterns), width)
    weights = np.zeros(width)
    # A few counted votes of single labelers keep the classifier defined where the corpus has no pattern.
    calm = np.vstack([x, np.eye(width)[1 + len(KINDS) : 1 + len(KINDS) + 2 * LABELERS] + np.eye(width)[0]])
    goal = np.concatenate([post, np.tile([0.8, 0.2], LABELERS)])
    mass = np.sqrt(np.concatenate([n, np.ones(2 * LABELERS)]))
    for _ in range(60):  # Newton steps of ridge logistic regression
        p = 1 / (1 + np.exp(-np.clip(calm @ weights, -50, 50)))
        slope = calm.T @ (mass * (goal - p)) - 0.05 * weights
        curve = (calm * (mass * np.maximum(p * (1 - p), 1e-4))[:, None]).T @ calm + 0.05 * np.eye(width)
        weights += np.clip(np.linalg.solve(curve, slope), -2, 2)
    return Model(weights, rely)


def vote_counts(docs: DataFrame, text_col: str = "text") -> dict[str, int]:
    """Counts of the vote patterns of all candidates of all texts: at most kinds x votes x length classes entries."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for part in parts:
            for text in part.column(0).to_pylist():
                if text:
                    for spans in candidates(text):
                        seen.update(pattern_of(text, s) for s in spans)
        yield pa.record_batch([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["pattern", "n"])

    counted = streams(docs.select(F.col(text_col).cast("string").alias("text")), run, "pattern string, n long")
    return {r["pattern"]: r["n"] for r in counted.groupBy("pattern").agg(F.sum("n").alias("n")).collect()}


def all_spans(text: str, model: Model, known: dict[str, bool]) -> tuple[list[Span], list[Span]]:
    fixed, further = candidates(text)
    kept = []
    for s in further:
        pattern = pattern_of(text, s)
        if pattern not in known:
            known[pattern] = model.probability(pattern) >= 0.5
        if known[pattern]:
            kept.append(s)
    return fixed, kept


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (KINDS.index(x[0]), x[1])))


def find(docs: DataFrame, model: Model | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans), one row per input row.

    Null and empty texts have no span. Places are code points, ends exclusive. Of further candidates that start at one
    place the longer stays, of equal ones the kind named first in KINDS. Repeated rows get equal results; other columns
    are not read.
    """
    model = model or fit(vote_counts(docs, text_col))
    read = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, bool] = {}
        for part in parts:
            rows = []
            for text in part.column(1).to_pylist():
                fixed, further = all_spans(text, model, known) if text else ([], [])
                n = Counter(k for k, _, _ in fixed)
                rows.append((*(n[k] for k in BASE), hashlib.sha256(_joined(fixed).encode()).hexdigest(), _joined([*fixed, *further])))
            columns = list(zip(*rows, strict=True))
            yield pa.record_batch([part.column(0), *(pa.array(c, pa.int64()) for c in columns[:4]), *(pa.array(c, pa.string()) for c in columns[4:])], ["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans"])

    return streams(read, run, f"doc_id {read.schema['doc_id'].dataType.simpleString()}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redact(docs: DataFrame, model: Model | None = None, text_col: str = "text") -> DataFrame:
    """The input with each span replaced by its kind in angle brackets; ``n_chars``, if there, follows the new text.

    Rows and other columns stay; texts without a span stay as they are.
    """
    model = model or fit(vote_counts(docs, text_col))
    names = docs.columns
    at = names.index(text_col)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, bool] = {}
        for part in parts:
            texts = part.column(at).to_pylist()
            counts = part.column(names.index("n_chars")).to_pylist() if "n_chars" in names else None
            for i, text in enumerate(texts):
                fixed, further = all_spans(text, model, known) if text else ([], [])
                if fixed or further:
                    out, done = [], 0
                    for kind, s, e in sorted([*fixed, *further], key=lambda x: (x[1], -x[2])):
                        if e > done:  # what overlaps an earlier span is hidden with it
                            out += [text[done : max(s, done)], f"<{kind.upper()}>" if s >= done else ""]
                            done = e
                    texts[i] = "".join([*out, text[done:]])
                    if counts is not None:
                        counts[i] = len(texts[i])
            columns = list(part.columns)
            columns[at] = pa.array(texts, pa.string())
            if counts is not None:
                columns[names.index("n_chars")] = pa.array(counts, part.schema.field(names.index("n_chars")).type)
            yield pa.record_batch(columns, names)

    return streams(docs, run, docs.schema)


def op7_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents"))


QUERIES = {"op7_pii_spans": op7_pii_spans}
SQL: dict[str, str] = {}
