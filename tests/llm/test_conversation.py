"""Conversation repair against every edit sequence, a plain dynamic programme, and a plain version of the whole query."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict
from itertools import product

import pytest

from peerlens.llm import conversation as C

SF = "/root/testdata/sf0.001"
LEGAL = re.compile(r"(s?(ua)+)?")
FULL = {"u": "user", "a": "assistant"}


def edits_of(rows):
    """(cost, audit, repaired roles) of all edit sequences with at most two inserts at a place."""
    gaps = [""] + [x for n in (1, 2) for x in map("".join, product("ua", repeat=n))]

    def consumed(initial, fault):
        yield 2, "D", ""
        if fault not in (C.BLANK, C.DUPLICATE):
            extra = 5 * (fault == C.CUT)
            yield extra, "K", initial
            for r in "ua":
                yield 1 + extra, "R", r

    paths = [(0, "", "")]
    for initial, fault in rows:
        paths = [(c + 5 * len(g) + d, a + "I" * len(g) + letter, out + g + r) for c, a, out in paths for g in gaps for d, letter, r in consumed(initial, fault)]
    return [(c + 5 * len(g), a + "I" * len(g), out + g) for c, a, out in paths for g in gaps]


def plain_best(rows):
    """(cost, audit) by a table of the least (cost, audit) for each row and last role."""
    after = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}

    def closed(level):
        for _ in range(8):
            for q, (c, a) in list(level.items()):
                for r in "ua":
                    if r in after[q]:
                        level[after[q][r]] = min(level.get(after[q][r], (1 << 30, "")), (c + 5, a + "I"))
        return level

    level = closed({"": (0, "")})
    for initial, fault in rows:
        new = {}
        for q, (c, a) in level.items():
            moves = [(2, "D", q)]
            if fault not in (C.BLANK, C.DUPLICATE):
                extra = 5 * (fault == C.CUT)
                moves += [(extra, "K", after[q][initial])] if initial in after[q] else []
                moves += [(1 + extra, "R", after[q][r]) for r in "ua" if r in after[q]]
            for d, letter, to in moves:
                new[to] = min(new.get(to, (1 << 30, "")), (c + d, a + letter))
        level = closed(new)
    return min(level[q] for q in ("", "a") if q in level)


def random_rows(rng, n):
    return [(rng.choice("uuuaaasx"), rng.choices([C.OK, C.BLANK, C.DUPLICATE, C.CUT], [6, 1, 1, 2])[0]) for _ in range(n)]


def test_search_finds_the_least_of_all_edits():
    rng = random.Random(3)
    for n in [0, 1, 1, 2, 2, 2, 3, 3, 3, 3]:
        rows = random_rows(rng, n)
        best = min((c, a) for c, a, out in edits_of(rows) if LEGAL.fullmatch(out))
        assert C.cheapest(rows, C.START, (C.START, C.AFTER_A), True) == best == plain_best(rows), rows


def test_search_and_chain_equal_the_table():
    rng = random.Random(5)
    for n in range(400):
        rows = random_rows(rng, n % 23)
        want = plain_best(rows)
        assert C.cheapest(rows, C.START, (C.START, C.AFTER_A), True) == want, rows
        if rows:
            size = rng.randint(1, 9)
            known = rng.random() < 0.5  # whether the task sees where the conversation starts and ends
            parts = [C._segment([("c", 0, i, b"", f) for i, f in rows[at : at + size]], known and at == 0, known and at + size >= len(rows)) for at in range(0, len(rows), size)]
            cost, picks = C.chain([(p["costs"], p["ranks"]) for p in parts])
            audit = "".join(p["audits"][k] for p, k in zip(parts, picks, strict=True)) + C._CLOSE[picks[-1] % 4]
            assert (cost, audit) == want, rows


def plain_query(rows):
    """The whole result for (conv_id, turn, role, text) rows, by definition."""
    space = lambda x: " " if x is None else str(x)
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        convs[conv]
        role, text = space(role), space(text)
        fate = zlib.crc32(f"{space(conv)}:{space(turn)}".encode()) % 20
        if fate == 0:
            continue
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        convs[conv] += [(turn, "user" if fate == 4 else role, text)] * (2 if fate == 3 else 1)
    out = {}
    for conv, held in convs.items():
        held.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).digest()))
        seen, faults = set(), []
        for _, role, text in held:
            bare = re.findall(r"[^\x20\x09-\x0D]", text)
            faults.append(C.BLANK if not bare else C.DUPLICATE if (role, text) in seen else C.CUT if bare[-1] not in ".!?" else C.OK)
            seen.add((role, text))
        cost, audit = plain_best([(r[1][:1], f) for r, f in zip(held, faults, strict=True)])
        lines, state, i = [], "", 0
        for letter in audit:
            nxt = "a" if state == "u" else "u"
            if letter == "I":
                lines.append(FULL[nxt] + ":")
                state = nxt
                continue
            if letter != "D":
                role = held[i][1] if letter == "K" else FULL[nxt]
                lines.append(f"{role}:{held[i][2]}")
                state = role[0]
            i += 1
        assert LEGAL.fullmatch("".join(x[0] for x in lines))
        turns = [t for t, _, _ in held if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(held, held[1:]))
        out[conv] = (gaps, faults.count(C.BLANK), faults.count(C.DUPLICATE), faults.count(C.CUT), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def found(df):
    rows = df.collect()
    assert len({r["conv_id"] for r in rows}) == len(rows)
    return {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in rows}


def test_query(spark):
    rows = [(r["conv_id"], r["turn"], r["role"], r["text"]) for r in spark.read.parquet(f"{SF}/conversations.parquet").collect()]
    assert found(C.op12_conversation_repair(spark, SF)) == plain_query(rows)


@pytest.mark.parametrize("segment", [3, 256])
def test_odd_rows(spark, segment):
    rng = random.Random(8)
    texts = ["Yes.", "No!", "cut", "", " \t", None, "Was?", "été…", "日本。", "x" * 100_000 + ".", "a\nb.", "1.", "2.", "3."]
    roles = ["user", "assistant", "user", "assistant", "system", None, "", "User", "superuser", "aide"]
    rows = [(rng.choice([None, 1, 2, 3, 4, 5]), rng.choice([None, *range(6)]), rng.choice(roles), rng.choice(texts)) for _ in range(60)]
    rows += [(7, i, ("user", "assistant")[i % 2], f"turn {i}.") for i in range(900)]  # many segments
    rows += [(8, 5, "user", "Same.")] * 40 + [(9, None, None, None)] * 3 + [(10, -3, "user", "x.")]
    alone = [k for k in range(1000, 1400) if zlib.crc32(f"{k}:0".encode()) % 20 == 0][:2]
    rows += [(k, 0, "user", "goes.") for k in alone]
    rng.shuffle(rows)
    df = spark.createDataFrame([(*r, "own", 1) for r in rows], "conv_id long, turn long, role string, text string, stage string, pick int").repartition(3)
    got = found(C.repair(df, C.damage(df), segment))
    assert got == plain_query(rows)
    assert all(got[k] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for k in alone)


def test_empty_table(spark):
    df = spark.createDataFrame([], "conv_id string, turn long, role string, text string")
    assert C.repair(df, C.damage(df)).count() == 0
