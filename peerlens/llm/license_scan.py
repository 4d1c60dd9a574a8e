"""Licence scans: exact phrases, and short notices found with a bounded number of edits.

Notices and texts are compared as words: A-Z in lower case, words of letters, digits and non-ASCII characters, joined
by single spaces. A notice with k edits allowed is split into k + 1 pieces; wherever it stands with at most k edits,
one piece stands unchanged (pigeonhole). An Aho-Corasick automaton finds all pieces of all notices in one pass over the
text; around each hit a window as long as the notice plus its edits goes to the regex library, whose bounded-error
matching verifies it and gives the span.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peerlens.llm.common import streams, table

#: Exact phrases and their labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: Short notices and their labels.
NOTICES = (
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit"),
    ("released under the mit license", "mit"),
    ("licensed under the apache license version 2 0", "apache"),
    ("licensed under the gnu general public license", "gpl"),
    ("licensed under the gnu lesser general public license", "lgpl"),
    ("licensed under the gnu affero general public license", "agpl"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("permission to use copy modify and or distribute this software for any purpose", "isc"),
    ("subject to the terms of the mozilla public license", "mpl"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("licensed under cc by 4 0", "cc-by"),
    ("licensed under cc by sa 4 0", "cc-by-sa"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("licensed under a creative commons attribution", "cc"),
    ("all rights reserved", "reserved"),
)
#: Edits allowed per notice character; short notices get none.
EDIT_RATE = 0.08

# In UTF-8: lower-cased letters, digits and all bytes of non-ASCII characters stay, the rest separates words.
_PLAIN = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in bytes(range(256)).lower())


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(_PLAIN).split()


def pieces(notice: str, edits: int) -> list[tuple[int, str]]:
    """(place, piece): the notice cut into edits + 1 nearly equal pieces."""
    cuts = [len(notice) * i // (edits + 1) for i in range(edits + 2)]
    return [(a, notice[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


class Scanner:
    def __init__(self, phrases: Sequence[tuple[str, str]] = PHRASES, notices: Sequence[tuple[str, str]] = NOTICES, rate: float = EDIT_RATE):
        self.phrases = [(f" {p} ", label) for p, label in phrases]
        self.notices = [(n, label, int(len(n) * rate)) for n, label in notices]
        # The fewest edits win, and of equal ones the first place.
        self.patterns = [regex.compile(rf"(?b)(?:{regex.escape(n, literal_spaces=True)}){{e<={k}}}") for n, _, k in self.notices]
        self.seeds = ahocorasick.Automaton()
        meant: dict[str, list[tuple[int, int]]] = {}
        for i, (n, _, k) in enumerate(self.notices):
            for at, piece in pieces(n, k):
                meant.setdefault(piece, []).append((i, at))
        for piece, uses in meant.items():
            self.seeds.add_word(piece, (len(piece), uses))
        self.seeds.make_automaton()

    def exact(self, joined: str) -> list[tuple[int, str]]:
        """(word place, label) of each place of each phrase; ``joined`` has a space at both ends."""
        found = []
        for phrase, label in self.phrases:
            at = joined.find(phrase)
            seen, words = 0, 0
            while at >= 0:
                words += joined.count(" ", seen, at)
                seen = at
                found.append((words, label))
                at = joined.find(phrase, at + 1)
        return found

    def windows(self, joined: str) -> list[tuple[int, int, int]]:
        """(notice, start, end): merged windows in which a notice could stand, by its seeds."""
        hits: dict[int, list[tuple[int, int]]] = {}
        for end, (length, uses) in self.seeds.iter(joined):
            for i, at in uses:
                notice, _, k = self.notices[i]
                low = end - length + 1 - at
                hits.setdefault(i, []).append((max(0, low - k), low + len(notice) + k))
        out = []
        for i, spans in sorted(hits.items()):
            spans.sort()
            start, stop = spans[0]
            for a, b in spans[1:]:
                # Windows are merged while they stay short, so that a text full of seeds is still searched in parts.
                if a <= start + 2 * len(self.notices[i][0]):
                    stop = max(stop, b)
                else:
                    out.append((i, start, stop))
                    start, stop = a, b
            out.append((i, start, stop))
        return out

    def _inside(self, joined: str, i: int, start: int, stop: int) -> Iterator[tuple[int, int, int, int]]:
        """Verified places of one notice in a window: the best one, then those before and after it."""
        notice, _, k = self.notices[i]
        if stop - start < len(notice) - k:
            return
        at = joined.find(f" {notice} ", max(0, start - 1), stop + 1)
        if at >= 0:
            s, e, d = at + 1, at + 1 + len(notice), 0
        else:
            m = self.patterns[i].search(joined, start, stop) if k else None
            if not m:
                return
            # Whole words: the edges of an inexact match are moved to the edges of the words they touch.
            s = joined.rfind(" ", 0, m.start() + 1) + 1
            e = joined.find(" ", max(m.end() - 1, s))
            d = sum(m.fuzzy_counts)
        yield from self._inside(joined, i, start, s)
        yield i, s, e, d
        yield from self._inside(joined, i, e, stop)

    def fuzzy(self, joined: str) -> list[tuple[int, int, int, int]]:
        """(notice, start, end, edits): whole words of ``joined``. Where notices overlap those with the fewest edits stay."""
        found = sorted({x for i, start, stop in self.windows(joined) for x in self._inside(joined, i, start, min(stop, len(joined)))}, key=lambda x: (x[3], x[1], x[0]))
        # A span overlaps only spans that start in the same or a neighbouring stretch of the text.
        stretch = 2 * max((len(n) for n, _, _ in self.notices), default=1)
        kept: dict[int, list[tuple[int, int, int, int]]] = {}
        for x in found:
            at = x[1] // stretch
            if not any(y[3] < x[3] and y[1] < x[2] and x[1] < y[2] for b in (at - 1, at, at + 1) for y in kept.get(b, ())):
                kept.setdefault(at, []).append(x)
        return sorted((x for xs in kept.values() for x in xs), key=lambda x: (x[1], x[0]))

    def scan(self, text: str | None) -> tuple:
        """(n_words, n_base, first, last, base_labels, labels, score, spans)."""
        words = words_of(text or "")
        joined = f" {b' '.join(words).decode()} " if words else ""
        exact = self.exact(joined)
        fuzzy = self.fuzzy(joined)
        base = {label for _, label in exact}
        labels = base | {self.notices[i][1] for i, *_ in fuzzy}
        # 1 for an exact phrase or notice, less by the share of the allowed edits used, 0 without a licence.
        score = max([1.0 if exact else 0.0, *(1 - 0.5 * d / max(1, self.notices[i][2]) for i, _, _, d in fuzzy)])
        places = [p for p, _ in exact]
        spans, at, first = [], 0, -1
        for i, s, e, d in fuzzy:  # by start, so each word is counted once
            first += joined.count(" ", at, s)
            at = s
            spans.append((self.notices[i][1], first, first + joined.count(" ", s, e), d))
        return len(words), len(exact), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score, spans


_SPAN = pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("edits", pa.int32())])
_FIELDS = [("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("spans", pa.list_(_SPAN))]
_DDL = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,first_word:bigint,last_word:bigint,edits:int>>"


def scan(docs: DataFrame, phrases: Sequence[tuple[str, str]] = PHRASES, notices: Sequence[tuple[str, str]] = NOTICES, rate: float = EDIT_RATE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, the counts and places of the phrases, all labels, the score, the notices' spans.

    A null text counts as empty: no word, no place, empty labels, score 0. Overlapping places of a phrase all count.
    Span places are words from 0, first and last inclusive. Repeated rows get equal results; other columns are not read.
    """
    given = (phrases, notices, rate)
    read = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Scanner(*given)  # the automaton is built in each task
        for part in parts:
            columns = list(zip(*(own.scan(t) for t in part.column(1).to_pylist()), strict=True)) or [()] * len(_FIELDS)
            spans = [[dict(zip(("label", "first_word", "last_word", "edits"), s, strict=True)) for s in row] for row in columns[-1]]
            arrays = [pa.array(c, kind) for c, (_, kind) in zip([*columns[:-1], spans], _FIELDS, strict=True)]
            yield pa.record_batch([part.column(0), *arrays], ["doc_id", *(n for n, _ in _FIELDS)])

    return streams(read, run, f"doc_id {read.schema['doc_id'].dataType.simpleString()}, {_DDL}")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


QUERIES = {"op2_license_scan": op2_license_scan}
SQL: dict[str, str] = {}
