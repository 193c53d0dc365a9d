import hashlib
import itertools
import random
import zlib

import numpy as np
import pytest

from tidemark.llm import conversation_repair as cr

NEXT = {"0": "u", "s": "u", "u": "a", "a": "u"}
SPACES = " \t\n\x0b\x0c\r"


def cheapest(rows):
    """``(cost, edits)`` by trying every edit: rows are ``(role initial, must go, truncated)``."""
    best = {}
    for i in range(len(rows), -1, -1):
        here = {}
        # Two inserts bring every state back to itself, so three rounds settle.
        for _ in range(3):
            for state in "0sua":
                ways = [(0, "")] if i == len(rows) and state in "0a" else []
                if NEXT[state] in here:
                    cost, text = here[NEXT[state]]
                    ways.append((cost + 2, "I" + text))
                if i < len(rows):
                    role, gone, cut_short = rows[i]
                    ways.append((best[i + 1][state][0] + 3, "D" + best[i + 1][state][1]))
                    if not gone:
                        if role and (role == NEXT[state] or (state, role) == ("0", "s")):
                            ways.append((best[i + 1][role][0] + cut_short, "K" + best[i + 1][role][1]))
                        cost, text = best[i + 1][NEXT[state]]
                        ways.append((cost + 2 + cut_short, "R" + text))
                if ways:
                    here[state] = min(ways)
        best[i] = here
    return best[0]["0"]


def digest(role, text):
    return hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()


def brute(rows):
    """Reports of ``(conv, turn, role, text)`` rows, with the repaired lines."""
    convs = {}
    for conv, turn, role, text in rows:
        convs.setdefault(conv, []).append((turn is not None, turn or 0, turn, " " if role is None else role, " " if text is None else text))
    out = {}
    for conv, found in convs.items():
        found.sort(key=lambda r: (r[0], r[1], digest(r[3], r[4])))
        seen, symbols, counts = set(), [], [0, 0, 0]
        for _, _, _, role, text in found:
            body = text.rstrip(SPACES)
            fault = 0 if not body else 1 if (role, text) in seen else 2 if body[-1] not in ".!?" else None
            seen.add((role, text))
            if fault is not None:
                counts[fault] += 1
            symbols.append((role[:1] if role[:1] in "sua" else "", fault in (0, 1), int(fault == 2)))
        turns = [r[2] for r in found if r[2] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        initials = [r[3][:1] for r in found]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        cost, audit = cheapest(symbols)
        lines, state, at = [], "0", 0
        for edit in audit:
            role, text = ("", "") if edit == "I" else found[at][3:]
            at += edit != "I"
            if edit == "D":
                continue
            state = role[:1] if edit == "K" else NEXT[state]
            lines.append(f"{role if edit == 'K' else {'u': 'user', 'a': 'assistant'}[state]}:{text}")
        out[conv] = (gaps, *counts, illegal, cost, audit, lines)
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def check(spark, df, rows):
    reports = cr.cut(cr.report(df)).cache()
    want = brute(rows)
    got = {r["conv_id"]: tuple(r)[1:] for r in reports.collect()}
    assert got == {c: w[:-1] for c, w in want.items()}
    lines = {}
    for r in cr.repaired(df, reports).collect():
        assert r["seq"] == len(lines.setdefault(r["conv_id"], []))
        lines[r["conv_id"]].append(f"{r['role']}:{r['text']}")
    assert lines == {c: w[-1] for c, w in want.items() if w[-1]}
    shas = {r[0]: r[1] for r in cr.digests(cr.repaired(df, reports)).collect()}
    assert shas == {c: hashlib.sha256("\n".join(x).encode()).hexdigest() for c, x in lines.items()}


ROLES = ["user", "assistant", "system", "tool", "", None, "User"]
TEXTS = ["Hi.", "Why?", "cut off", "", " \t", None, "end! \n", "?", "ünï漢", "x\xa0"]


def random_rows(seed, conversations, longest):
    rng, rows = random.Random(seed), []
    for conv in range(conversations):
        for turn in range(rng.randrange(1, longest)):
            text = rng.choice(TEXTS) if rng.random() < 0.4 else f"t{rng.randrange(40)}."
            role = rng.choice(ROLES) if rng.random() < 0.3 else ("user", "assistant")[turn % 2]
            rows.append((conv if conv else None, rng.choice([turn, turn, 3 * turn, None, 5]), role, text))
            if rng.random() < 0.1:
                rows.append(rows[-1])
    rng.shuffle(rows)
    return rows


def test_blocks_against_every_edit():
    known = cr.tables()
    kinds = [(r, False, t) for r in ("s", "u", "a", "") for t in (0, 1)] + [("u", True, 0)]
    for length in range(4):
        for symbols in itertools.product(range(cr.SYMBOLS), repeat=length):
            assert known.repair(np.array(symbols, np.int64)) == cheapest([kinds[s] for s in symbols])
    rng = random.Random(1)
    for _ in range(300):
        symbols = rng.choices(range(cr.SYMBOLS), k=rng.randrange(60))
        assert known.repair(np.array(symbols, np.int64)) == cheapest([kinds[s] for s in symbols])


def test_block_length_changes_nothing():
    rng = random.Random(2)
    symbols = np.array(rng.choices(range(cr.SYMBOLS), k=1000))
    assert len({cr.Tables(size).repair(symbols) for size in (1, 2, 3, 5)} | {cr.tables().repair(symbols)}) == 1


@pytest.mark.parametrize("seed", [1, 2])
def test_random_conversations(spark, seed):
    rows = random_rows(seed, 60, 20)
    df = frame(spark, rows).selectExpr("*", "1 AS seq", "'x' AS audit", "2 AS part", "3 AS conv").repartition(5)
    check(spark, df, rows)


def test_one_long_conversation(spark):
    """A third of the rows is one conversation, over several parts; some turns and texts fill much of it."""
    rng = random.Random(3)
    rows = [(7, rng.choice([t, t, t, 50, None]), rng.choice(ROLES[:3]), rng.choice(["same.", f"n{t}."])) for t in range(3000)]
    rows += [(100 + k, t, ("user", "assistant")[t % 2], f"{t}.") for k in range(600) for t in range(10)]
    df = frame(spark, rows).repartition(6)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        parts = cr._parts(cr._symbols(cr._rows(df, "conv_id", "turn", "role", "text")))
        assert parts.where("conv = 7").count() > 2
        check(spark, df, rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_empty(spark):
    df = frame(spark, [])
    assert cr.report(df).count() == 0
    assert cr.repaired(df, cr.report(df)).count() == 0
    assert cr.audit_of_damaged(df).count() == 0


def test_damage_and_query(spark):
    rows = random_rows(4, 80, 9) + [(5000 + k, k, "user", "one.") for k in range(60)]
    want = []
    for conv, turn, role, text in rows:
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if fault == 1:
            text = ""
        if fault == 2:
            text = "".join(c for c in text if c not in ".!?")
        if fault:
            want += [(conv, turn, "user" if fault == 4 else role, text)] * (1 + (fault == 3))
    assert sorted(map(tuple, cr.damaged(frame(spark, rows)).collect()), key=repr) == sorted(want, key=repr)
    found = brute(want)
    got = {r[0]: tuple(r)[1:] for r in cr.audit_of_damaged(frame(spark, rows)).collect()}
    none = (0, 0, 0, 0, 0, 0, "", [])
    expected = {c: found.get(c, none) for c in {r[0] for r in rows}}
    assert any(w is none for w in expected.values())
    assert got == {c: (*w[:-1], hashlib.sha256("\n".join(w[-1]).encode()).hexdigest()) for c, w in expected.items()}
