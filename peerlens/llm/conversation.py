"""Conversation structure repair: the cheapest edits that give a legal order of roles, by bidirectional Dijkstra over the edit lattice.

A lattice node is (rows consumed, role last put out). Keep, rerole and delete consume a row, insert does not; the roles put
out have to spell ``(s?(ua)+)?``. From a node each edit leads to one node only, so an audit (the edits' initials) fixes the repair.

One conversation may hold any share of all rows, so no task gets a whole one. Narrow rows (role, text digest, fault) are
range-sorted by conversation and turn; a task cuts what it sees of a conversation into segments of at most ``SEGMENT`` rows
and searches each from every role it can be entered with to every role it can be left with (one search where it sees the conversation whole). A segment's audits end in a
consumed row, so two of them are never prefixes of each other, and sixteen costs with the alphabetical ranks of the audits
are all that a conversation's segments need to be chained. The digest of a repaired conversation is a chain of SHA-256
blocks: rows stream through it in order, sorted on disk, one at a time.
"""

from __future__ import annotations

import hashlib
import heapq
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peerlens.llm.common import aside, streams, table

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
SEGMENT = 256
START, AFTER_S, AFTER_U, AFTER_A = range(4)
#: Role put out next by a rerole or an insert, and the state it leads to.
_NEXT = {START: ("u", AFTER_U), AFTER_S: ("u", AFTER_U), AFTER_U: ("a", AFTER_A), AFTER_A: ("u", AFTER_U)}
_ROLES = {"u": "user", "a": "assistant"}
#: Inserts that make a legal end of the last role.
_CLOSE = {START: "", AFTER_S: "II", AFTER_U: "I", AFTER_A: ""}
OK, BLANK, DUPLICATE, CUT = "ok", "blank", "duplicate", "truncated"


# The lattice


def _kept(state: int, initial: str) -> int | None:
    """State after a row with this role initial is put out, None where that is not legal."""
    if state == START and initial == "s":
        return AFTER_S
    role, after = _NEXT[state]
    return after if role == initial else None


def _consume(state: int, initial: str, fault: str) -> Iterator[tuple[str, int, int]]:
    """(letter, cost, state after) of the edits that consume a row."""
    yield "D", DELETE, state
    if fault not in (BLANK, DUPLICATE):
        extra = TRUNCATED * (fault == CUT)
        after = _kept(state, initial)
        if after is not None:
            yield "K", KEEP + extra, after
        yield "R", REROLE + extra, _NEXT[state][1]


def _forward(rows: list[tuple[str, str]], node: tuple[int, int], inserts_at_end: bool) -> Iterator[tuple[str, int, tuple[int, int]]]:
    i, state = node
    if i < len(rows):
        for letter, cost, after in _consume(state, *rows[i]):
            yield letter, cost, (i + 1, after)
    if i < len(rows) or inserts_at_end:
        yield "I", INSERT, (i, _NEXT[state][1])


def _backward(rows: list[tuple[str, str]], node: tuple[int, int], inserts_at_end: bool) -> Iterator[tuple[str, int, tuple[int, int]]]:
    i, state = node
    for before in range(4):
        for letter, cost, after in _consume(before, *rows[i - 1]) if i else ():
            if after == state:
                yield letter, cost, (i - 1, before)
        if (i < len(rows) or inserts_at_end) and _NEXT[before][1] == state:
            yield "I", INSERT, (i, before)


def cheapest(rows: list[tuple[str, str]], entry: int, exits: tuple[int, ...], inserts_at_end: bool) -> tuple[int, str] | None:
    """(cost, alphabetically least audit) of the cheapest edits of rows (role initial, fault) from a state to one of the exits.

    Two heaps, one from each end. The forward one pops by (cost, audit): audits only grow, so the first audit that reaches a
    node is its least. The reverse one pops by (cost, rows left): edits that cost nothing consume a row, so a node is popped after all
    nodes its remaining edits lead to, with the least first letter; letters from a node differ, so that letter fixes the audit. The search goes on
    until no path of the best cost can be outside both searched regions; then the crossings of that cost are compared.
    """
    source, n = (0, entry), len(rows)
    ahead: dict[tuple[int, int], tuple[int, str]] = {}
    behind: dict[tuple[int, int], tuple[int, str | None, tuple[int, int] | None]] = {}
    front: list = [(0, "", source)]
    back: list = [(0, -n, (n, x), None, None) for x in exits]
    heapq.heapify(back)
    best = None
    while front or back:
        if best is not None and (front[0][0] if front else 0) + (back[0][0] if back else 0) > best:
            break
        if front and (not back or front[0][0] <= back[0][0]):
            cost, audit, node = heapq.heappop(front)
            if node in ahead:
                continue
            ahead[node] = cost, audit
            for letter, more, after in _forward(rows, node, inserts_at_end):
                if after not in ahead:
                    heapq.heappush(front, (cost + more, audit + letter, after))
                if after in behind:
                    best = cost + more + behind[after][0] if best is None else min(best, cost + more + behind[after][0])
            if node in behind:
                best = cost + behind[node][0] if best is None else min(best, cost + behind[node][0])
        else:
            cost, _, node, letter, after = heapq.heappop(back)
            if node in behind:
                continue
            behind[node] = cost, letter, after
            for letter, more, before in _backward(rows, node, inserts_at_end):
                heapq.heappush(back, (cost + more, -before[0], before, letter, node))
                if before in ahead:
                    best = cost + more + ahead[before][0] if best is None else min(best, cost + more + ahead[before][0])
            if node in ahead:
                best = cost + ahead[node][0] if best is None else min(best, cost + ahead[node][0])
    if best is None:
        return None

    def rest(node: tuple[int, int]) -> str:
        letters = []
        while behind[node][1] is not None:
            letters.append(behind[node][1])
            node = behind[node][2]
        return "".join(letters)

    audits = [audit + rest(node) for node, (cost, audit) in ahead.items() if node in behind and cost + behind[node][0] == best]
    for node, (cost, audit) in ahead.items():
        for letter, more, after in _forward(rows, node, inserts_at_end):
            if after in behind and cost + more + behind[after][0] == best:
                audits.append(audit + letter + rest(after))
    return best, min(audits)


def chain(segments: list[tuple[list[int], list[int]]]) -> tuple[int, list[int]]:
    """(cost, chosen 4 * entry + exit of each segment) from each segment's costs (-1: impossible) and ranks of audits, by 4 * entry + exit."""
    left = [INSERT * len(_CLOSE[x]) for x in range(4)]
    choices = []
    for costs, ranks in reversed(segments):
        nothing = (math.inf, 0, 0)  # an entry that was not searched, since nothing leads to it
        chosen = [min(((costs[4 * e + x] + left[x], ranks[4 * e + x], x) for x in range(4) if costs[4 * e + x] >= 0), default=nothing) for e in range(4)]
        choices.append([c[2] for c in chosen])
        left = [c[0] for c in chosen]
    picks, state = [], START
    for choice in reversed(choices):
        picks.append(4 * state + choice[state])
        state = choice[state]
    return int(left[START]), picks


# Spark


def damage(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with the faults that crc32 of ``conv_id:turn`` deals out; nulls count as one space, also in the two texts."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat_ws(":", text("conv_id"), text("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), text("role").alias("role"), text("text").alias("text"), fate.alias("fate")).where("fate <> 0")
    return rows.select(
        "conv_id",
        "turn",
        F.when(F.col("fate") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.sequence(F.lit(1), F.when(F.col("fate") == 3, 2).otherwise(1))).alias("copy"),
    ).drop("copy")


def _ddl(df: DataFrame) -> str:
    return df.schema["conv_id"].dataType.simpleString()


def _stream(df: DataFrame, function, ddl: str) -> DataFrame:
    """Rows as tuples in, dicts out, in batches."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(ddl))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for out in function(row for part in parts for row in zip(*(c.to_pylist() for c in part.columns), strict=True)):
            held.append(out)
            if len(held) == 64:
                yield pa.RecordBatch.from_pylist(held, schema)
                held = []
        if held:
            yield pa.RecordBatch.from_pylist(held, schema)

    return streams(df, run, ddl)


def _runs(rows: Iterator[tuple]) -> Iterator[tuple[object, Iterator[tuple]]]:
    """Consecutive rows with one first column; each run is read through before the next begins."""
    from itertools import groupby

    yield from groupby(rows, key=lambda r: (r[0],))


def _legal(a: str, b: str) -> bool:
    return a + b in ("su", "ua", "au")


def marked(damaged: DataFrame) -> DataFrame:
    """(conv_id, turn, role, digest, fault, row) of each damaged row, a written table; a row has the first fault that fits."""
    bare = F.rtrim("text", F.lit(" \t\n\x0b\f\r"))
    fault = F.when(bare == "", BLANK).when(~F.right(bare, F.lit(1)).isin(".", "!", "?"), CUT).otherwise(OK)
    rows = aside(damaged.select("conv_id", "turn", "role", F.unhex(F.md5("text")).alias("digest"), fault.alias("fault"), F.monotonically_increasing_id().alias("row")), "conversation-rows")
    place = F.struct(F.col("turn").isNotNull().alias("known"), "turn", "row")
    first = rows.groupBy(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d")).agg(F.min(place).alias("first"))
    both = rows.join(first, rows["conv_id"].eqNullSafe(first["c"]) & (rows["role"] == first["r"]) & (rows["digest"] == first["d"]))
    again = (F.col("fault") != BLANK) & (F.col("first.row") != F.col("row"))
    return both.select("conv_id", "turn", "role", "digest", F.when(again, DUPLICATE).otherwise(F.col("fault")).alias("fault"), "row")


def segments(rows: DataFrame, size: int = SEGMENT) -> DataFrame:
    """One row per segment, numbered by (part, seg) in the order of the conversation: counts, ends, and the costs, ranks and audits of its sixteen passages."""
    kind = _ddl(rows)
    ddl = f"""conv_id {kind}, part int, seg int, n_blank long, n_duplicate long, n_cut long, n_illegal long, first_role string, last_role string, n_turns long, first_turn long,
        last_turn long, costs array<int>, ranks array<int>, audits array<string>, turns array<bigint>, roles array<string>, digests array<binary>"""
    keys = ["conv_id", F.asc_nulls_first("turn"), "role", "digest", "row"]
    ordered = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).select("conv_id", "turn", "role", "digest", "fault")

    def run(stream: Iterator[tuple]) -> Iterator[dict]:
        from pyspark import TaskContext

        part, seg, held, starts = TaskContext.get().partitionId(), 0, [], False

        def out(ends: bool) -> dict:
            return {"conv_id": held[0][0], "part": part, "seg": seg} | _segment(held, starts, ends)

        for row in stream:
            # The first conversation of a partition may have begun, and the last may go on, in another one.
            other = bool(held) and row[0] != held[0][0]
            if other or len(held) == size:
                yield out(other)
                seg, held, starts = seg + 1, [], other
            held.append(row)
        if held:
            yield out(False)

    return aside(_stream(ordered, run, " ".join(ddl.split())), "conversation-segments")


def _passages(rows: list[tuple[str, str]], starts: bool, ends: bool) -> dict[tuple[int, int], tuple[int, str]]:
    """(cost, audit) by (entry, exit). Where a conversation is known to start or end, only what can come of it is searched."""
    found = {}
    for entry in (START,) if starts else range(4):
        if ends:
            cost, audit = cheapest(rows, entry, (START, AFTER_A), True)
            consumed = audit.rstrip("I")
            state, i = entry, 0
            for letter in consumed:
                if letter in "RI":
                    state = _NEXT[state][1]
                elif letter == "K":
                    state = _kept(state, rows[i][0])
                i += letter != "I"
            found[entry, state] = cost - INSERT * len(_CLOSE[state]), consumed
            continue
        for leave in range(4):
            one = cheapest(rows, entry, (leave,), False)
            if one is not None:
                found[entry, leave] = one
    return found


def _segment(held: list[tuple], starts: bool, ends: bool) -> dict:
    initials = [r[2][:1] for r in held]
    faults = [r[4] for r in held]
    turns = [r[1] for r in held if r[1] is not None]
    found = _passages(list(zip(initials, faults, strict=True)), starts, ends)
    costs, ranks, audits = [-1] * 16, [-1] * 16, [None] * 16
    for entry in range(4):
        order = sorted(audit for (e, _), (_, audit) in found.items() if e == entry)
        for (e, leave), (cost, audit) in found.items():
            if e == entry:
                costs[4 * e + leave], ranks[4 * e + leave], audits[4 * e + leave] = cost, order.index(audit), audit
    return {
        "n_blank": faults.count(BLANK),
        "n_duplicate": faults.count(DUPLICATE),
        "n_cut": faults.count(CUT),
        "n_illegal": sum(not _legal(a, b) for a, b in zip(initials[:-1], initials[1:], strict=True)),
        "first_role": initials[0],
        "last_role": initials[-1],
        "n_turns": len(set(turns)),
        "first_turn": min(turns, default=None),
        "last_turn": max(turns, default=None),
        "costs": costs,
        "ranks": ranks,
        "audits": audits,
        "turns": [r[1] for r in held],
        "roles": [r[2] for r in held],
        "digests": [r[3] for r in held],
    }


def chained(pieces: DataFrame) -> DataFrame:
    """For each segment its passage (``pick``); the first segment of a conversation also has the counts and the cost of the whole."""
    ddl = f"conv_id {_ddl(pieces)}, part int, seg int, pick int, gaps long, blank long, duplicate long, truncated long, illegal long, cost long"
    narrow = pieces.select("conv_id", "part", "seg", "n_blank", "n_duplicate", "n_cut", "n_illegal", "first_role", "last_role", "n_turns", "first_turn", "last_turn", "costs", "ranks")

    def run(stream: Iterator[tuple]) -> Iterator[dict]:
        for (conv,), run_ in _runs(stream):
            parts = list(run_)
            cost, picks = chain([(p[12], p[13]) for p in parts])
            timed = [p for p in parts if p[9]]
            gaps = 0
            if timed:
                distinct = sum(p[9] for p in timed) - sum(a[11] == b[10] for a, b in zip(timed[:-1], timed[1:], strict=True))
                gaps = timed[-1][11] - timed[0][10] + 1 - distinct
            illegal = sum(p[6] for p in parts) + sum(not _legal(a[8], b[7]) for a, b in zip(parts[:-1], parts[1:], strict=True))
            whole = {"gaps": gaps, "blank": sum(p[3] for p in parts), "duplicate": sum(p[4] for p in parts), "truncated": sum(p[5] for p in parts), "illegal": illegal, "cost": cost}
            for p, pick in zip(parts, picks, strict=True):
                yield {"conv_id": conv, "part": p[1], "seg": p[2], "pick": pick} | whole
                whole = {}

    return aside(_stream(narrow.repartition("conv_id").sortWithinPartitions("conv_id", "part", "seg"), run, ddl), "conversation-chains")


def edits(pieces: DataFrame, picks: DataFrame) -> DataFrame:
    """The audit of each segment (``put`` null) and, for each row it puts out, the inserted roles before it and its own role."""
    ddl = f"conv_id {_ddl(pieces)}, part int, seg int, turn long, role string, digest binary, before string, put string, audit string"
    both = pieces.join(picks.select("part", "seg", "pick"), ["part", "seg"])

    def run(stream: Iterator[tuple]) -> Iterator[dict]:
        for conv, part, seg, audit, pick, turns, roles, digests in stream:
            at = {"conv_id": conv, "part": part, "seg": seg}
            yield at | {"audit": audit}
            state, i, before = pick // 4, 0, ""
            for letter in audit:
                if letter == "I":
                    before, state = before + _NEXT[state][0], _NEXT[state][1]
                    continue
                if letter != "D":
                    role = roles[i] if letter == "K" else _ROLES[_NEXT[state][0]]
                    state = _kept(state, role[:1])
                    yield at | {"turn": turns[i], "role": roles[i], "digest": digests[i], "before": before, "put": role}
                    before = ""
                i += 1

    return _stream(both.select("conv_id", "part", "seg", F.element_at("audits", F.col("pick") + 1).alias("audit"), "pick", "turns", "roles", "digests"), run, ddl)


def repair(conversations: DataFrame, damaged: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256), one row per conversation of ``conversations``.

    ``damaged`` are the rows to repair (conv_id, turn, role, text; roles and texts without nulls). They are taken by turn, nulls first,
    rows of one turn by role and digest of the text; of equal rows all but one are duplicates. A null conv_id is a conversation like
    any other. A conversation without rows has zeros, an empty audit and the digest of nothing. Long conversations are cut into
    segments of ``segment`` rows, which changes no result; other columns are not looked at.
    """
    kind = _ddl(conversations)
    cut = segments(marked(damaged), segment)
    picks = chained(cut)
    whole = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    everyone = conversations.select("conv_id").distinct()
    counts = everyone.join(picks.where("cost is not null").select(F.col("conv_id").alias("c"), *whole), F.col("conv_id").eqNullSafe(F.col("c")), "left").select("conv_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in whole])
    # What meets in the last stream, in this order: a conversation's counts, its audits, and each edited row right before its text.
    ends = counts.select("conv_id", F.lit(0).alias("stage"), F.struct(*whole).alias("whole"))
    made = edits(cut, picks).withColumn("stage", F.when(F.col("put").isNull(), 1).otherwise(2)).withColumn("known", F.col("turn").isNotNull())
    made = made.withColumn("order", F.when(F.col("stage") == 1, F.struct("part", "seg"))).drop("part", "seg").withColumn("kind", F.lit(0))
    texts = damaged.select("conv_id", F.lit(2).alias("stage"), F.col("turn").isNotNull().alias("known"), "turn", "role", F.unhex(F.md5("text")).alias("digest"), F.lit(1).alias("kind"), "text")
    rows = ends.unionByName(made, allowMissingColumns=True).unionByName(texts, allowMissingColumns=True)
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "stage", "order", "known", "turn", "role", "digest", "kind")
    ddl = f"conv_id {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"

    def run(stream: Iterator[tuple]) -> Iterator[dict]:
        for (conv,), run_ in _runs(stream):
            total, audits, state, lines, pending = None, [], START, Lines(), None
            for _, stage, summary, audit, turn, role, digest, before, put, text in run_:
                if stage == 0:
                    total = summary
                elif stage == 1:
                    audits.append(audit)
                elif put is not None:
                    pending = (turn, role, digest), before, put
                elif pending is not None and pending[0] == (turn, role, digest):
                    for r in pending[1]:
                        lines.add(f"{_ROLES[r]}:")
                    lines.add(f"{pending[2]}:{text}")
                    state, pending = {"s": AFTER_S, "u": AFTER_U, "a": AFTER_A}[pending[2][0]], None
            for r in {START: "", AFTER_S: "ua", AFTER_U: "a", AFTER_A: ""}[state]:
                lines.add(f"{_ROLES[r]}:")
            yield {"conv_id": conv} | total | {"audit": "".join(audits) + _CLOSE[state], "repaired_sha256": lines.digest.hexdigest()}

    return _stream(rows.select("conv_id", "stage", "whole", "audit", "turn", "role", "digest", "before", "put", "text"), run, ddl)


class Lines:
    """SHA-256 of newline-joined lines, one at a time."""

    def __init__(self):
        self.digest, self.empty = hashlib.sha256(), True

    def add(self, line: str) -> None:
        self.digest.update(("" if self.empty else "\n").encode() + line.encode())
        self.empty = False


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, damaged and repaired."""
    conversations = table(spark, sf_dir, "conversations")
    return repair(conversations, damage(conversations))


QUERIES = {"op12_conversation_repair": op12_conversation_repair}
#: A least path with its letters is no SQL aggregate; tests/llm compares with every edit sequence and a plain dynamic programme.
SQL: dict[str, str] = {}
