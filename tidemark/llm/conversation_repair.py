"""Conversations repaired to the role pattern ``(s?(ua)+)?`` with the cheapest edits.

A row becomes one symbol: the initial of its role, and whether it must go (blank, or a copy of an
earlier row), is truncated, or neither.  For each position of a conversation the cheapest cost of
repairing the rest is a vector over four states (nothing yet, after system, user, assistant).  Less
its least entry the vector is one of few, so what a block of symbols does to a vector is looked up
in tables made in advance for every block of ``BLOCK`` symbols.  Blocks are looked up from the last
to the first, keeping one vector number for each.  For the edits a block is expanded backward from
its vector into those of its single rows; with the cost of all that follows at hand, the smallest
letter among the cheapest edits is the start of the smallest of the cheapest edit strings.

On Spark the texts stay behind: rows move as symbols.  A range exchange orders them and parts a
conversation of any length; each part becomes one string of symbols.  Only these strings, a byte a
row as the edit string itself, meet in one task for each conversation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.plans.durable import cut

#: Symbols of a block.
BLOCK = 4
DELETE, EDIT, CUT_SHORT = 3, 2, 1
START, SYSTEM, USER, ASSISTANT = range(4)
#: State after a kept row, by state and role (system, user, assistant, other).
KEPT = ((SYSTEM, USER, None, None), (None, USER, None, None), (None, None, ASSISTANT, None), (None, USER, None, None))
#: State after an inserted row or one with a new role.
MADE = (USER, USER, ASSISTANT, USER)
ROLES = {USER: "user", ASSISTANT: "assistant"}
PLAIN, TRUNCATED, GONE = range(3)
#: A row that must go is the same symbol in every role.
SYMBOLS = 9
#: The letters of symbols: role times 3 plus fault.
LETTERS = "abcdefghijkl"
BLANKS = " \t\n\x0b\x0c\r"


def _closed(costs: list[int]) -> tuple[int, ...]:
    """Costs of the rest, where rows may be inserted first."""
    user = min(costs[USER], EDIT + costs[ASSISTANT])
    assistant = min(costs[ASSISTANT], EDIT + costs[USER])
    return min(costs[START], EDIT + user), min(costs[SYSTEM], EDIT + user), user, assistant


def _before(after: tuple[int, ...], symbol: int) -> tuple[int, ...]:
    """Costs before a row from those after it."""
    if symbol == SYMBOLS - 1:
        return _closed([DELETE + c for c in after])
    role, extra = symbol // 2, CUT_SHORT * (symbol % 2)
    costs = []
    for state in range(4):
        ways = [DELETE + after[state], EDIT + extra + after[MADE[state]]]
        if KEPT[state][role] is not None:
            ways.append(extra + after[KEPT[state][role]])
        costs.append(min(ways))
    return _closed(costs)


class Tables:
    """All vectors that occur, and what single symbols and blocks of symbols make of them."""

    def __init__(self, block: int = BLOCK):
        self.block = block
        end = _closed([0, 1 << 20, 1 << 20, 0])
        self.vectors, numbers, steps = [end], {end: 0}, []
        for vector in self.vectors:  # grows as it goes
            row = []
            for symbol in range(SYMBOLS):
                costs = _before(vector, symbol)
                normal = tuple(c - min(costs) for c in costs)
                if normal not in numbers:
                    numbers[normal] = len(self.vectors)
                    self.vectors.append(normal)
                row.append((numbers[normal], min(costs)))
            steps.append(row)
        self.step = np.array(steps)[:, :, 0].astype(np.int32)
        self.added = np.array(steps)[:, :, 1]
        # A block's code has its first symbol as the highest digit; its last symbol is taken first.
        self.place = SYMBOLS ** np.arange(block - 1, -1, -1)
        codes = np.arange(SYMBOLS**block)
        to = np.repeat(np.arange(len(steps), dtype=np.int32)[:, None], len(codes), axis=1)
        cost = np.zeros(to.shape, np.int64)
        for place in self.place[::-1]:
            digit = codes // place % SYMBOLS
            cost += self.added[to, digit]
            to = self.step[to, digit]
        # Plain lists: the walk over the blocks is one lookup each.
        self.to, self.cost = to.tolist(), cost.tolist()
        self.expand = cache(self._expand)

    def _edits(self, after: int, symbol: int, state: int) -> tuple[str, int]:
        """The edits up to and with one row, and the state behind it; ``after``: the vector behind it."""
        rest, here = self.vectors[after], _before(self.vectors[after], symbol)
        extra, letters = CUT_SHORT * (symbol % 2), ""
        while True:
            if here[state] == DELETE + rest[state]:
                return letters + "D", state
            if here[state] == EDIT + here[MADE[state]]:
                letters, state = letters + "I", MADE[state]
                continue
            kept = KEPT[state][symbol // 2]
            if kept is not None and here[state] == extra + rest[kept]:
                return letters + "K", kept
            return letters + "R", MADE[state]

    def _expand(self, after: int, symbols: tuple[int, ...], state: int) -> tuple[str, int]:
        """The edits of a block, from the vector behind it and the state before it."""
        behind = [after]
        for symbol in symbols[:0:-1]:
            behind.append(int(self.step[behind[-1], symbol]))
        out = []
        for symbol, vector in zip(symbols, reversed(behind)):
            letters, state = self._edits(vector, symbol, state)
            out.append(letters)
        return "".join(out), state

    def repair(self, symbols: np.ndarray) -> tuple[int, str]:
        """The least cost, and of the cheapest edit strings the smallest."""
        first = len(symbols) % self.block
        blocks = symbols[first:].reshape(-1, self.block)
        codes = (blocks @ self.place).tolist()
        vector, total, behind = 0, 0, [0] * len(codes)
        for k in range(len(codes) - 1, -1, -1):
            behind[k] = vector
            total += self.cost[vector][codes[k]]
            vector = self.to[vector][codes[k]]
        front, start = symbols[:first].tolist(), vector
        for symbol in reversed(front):
            total += int(self.added[vector, symbol])
            vector = int(self.step[vector, symbol])
        total += self.vectors[vector][START]
        text, state = self.expand(start, tuple(front), START) if front else ("", START)
        out = [text]
        for k, block in enumerate(blocks.tolist()):
            text, state = self.expand(behind[k], tuple(block), state)
            out.append(text)
        # What is missing at the end: an answer, or a question and an answer.
        out.append("I" * {SYSTEM: 2, USER: 1}.get(state, 0))
        return total, "".join(out)


@cache
def tables() -> Tables:
    return Tables()


def symbol_numbers(letters: np.ndarray) -> np.ndarray:
    """Symbols of the tables from letters (bytes) of :data:`LETTERS`."""
    role, fault = np.divmod(letters.astype(np.int64) - ord(LETTERS[0]), 3)
    return np.where(fault == GONE, SYMBOLS - 1, 2 * role + fault)


def illegal_pairs(letters: np.ndarray) -> int:
    """Neighbours whose roles are not system-user, user-assistant or assistant-user."""
    role = (letters.astype(np.int64) - ord(LETTERS[0])) // 3
    pair = role[:-1] * 4 + role[1:]
    return int((~np.isin(pair, (1, 6, 9))).sum())


def _digest(role: Column, text: Column) -> Column:
    """Tells rows apart, and orders rows of one turn."""
    return F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))


def _rows(df: DataFrame, conv_id: str, turn: str, role: str, text: str) -> DataFrame:
    """``(conv, turn, digest, role, text)``, nulls in role and text as one space."""
    role_, text_ = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" ")) for c in (role, text))
    plain = df.select(F.col(f"`{conv_id}`").alias("conv"), F.col(f"`{turn}`").cast("long").alias("turn"), role_.alias("role"), text_.alias("text"))
    return plain.select("conv", "turn", _digest(F.col("role"), F.col("text")).alias("digest"), "role", "text")


def _symbols(rows: DataFrame) -> DataFrame:
    """``(conv, turn, digest, letters, blank, duplicate, truncated)``: equal rows of a turn as one, with their counts."""
    body = F.rtrim("text", F.lit(BLANKS))
    initial = F.left("role", F.lit(1))
    narrow = rows.select(
        "conv",
        "turn",
        "digest",
        F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3).alias("kind"),
        (body == "").alias("empty"),
        (~F.right(body, F.lit(1)).isin(".", "!", "?")).alias("open"),
    )
    found = cut(narrow.groupBy("conv", "turn", "digest", "kind", "empty", "open").agg(F.count(F.lit(1)).alias("n")))
    # Counts and least turns are made in the map tasks; a hot pair of conversation and text is one row here.
    firsts = found.groupBy("conv", "digest").agg(F.min(F.struct("turn")).alias("first"))
    same = [found[c].eqNullSafe(firsts[c]) for c in ("conv", "digest")]
    found = found.join(firsts.hint("merge"), same).select(found["*"], "first")
    new = F.struct("turn").eqNullSafe(F.col("first"))
    fault = F.when(F.col("empty") | ~new, GONE).when(F.col("open"), TRUNCATED).otherwise(PLAIN)

    def letter(fault: Column) -> Column:
        return F.substring(F.lit(LETTERS), F.col("kind") * 3 + fault + 1, F.lit(1))

    rest = F.repeat(letter(F.lit(GONE)), (F.col("n") - 1).cast("int"))
    return found.select(
        "conv",
        "turn",
        "digest",
        F.concat(letter(fault), rest).alias("letters"),
        F.when(F.col("empty"), F.col("n")).otherwise(0).alias("blank"),
        F.when(F.col("empty"), 0).otherwise(F.col("n") - new.cast("long")).alias("duplicate"),
        (~F.col("empty") & new & F.col("open")).cast("long").alias("truncated"),
    )


_COUNTS = ("blank", "duplicate", "truncated")


def _parts(symbols: DataFrame) -> DataFrame:
    """One row for each conversation of each part of the order, with what its rows come to."""
    fields = [("part", T.IntegerType()), ("letters", T.StringType()), *[(c, T.LongType()) for c in _COUNTS]]
    fields += [(c, T.LongType()) for c in ("low", "high", "turns")]
    schema = T.StructType([symbols.schema["conv"], *(T.StructField(*f) for f in fields)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, kind, out = TaskContext.get().partitionId(), None, []
        conv, letters, sums, turns = None, [], [0, 0, 0], [None, None, 0]

        def flushed() -> pa.RecordBatch:
            types = [kind, pa.int32(), pa.string(), *[pa.int64()] * 6]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=schema.names)

        for batch in batches:
            kind = batch.column(0).type
            for c, turn, letter, *counts in zip(*(batch.column(n).to_pylist() for n in ("conv", "turn", "letters", *_COUNTS))):
                if c != conv and letters:
                    out.append((conv, part, "".join(letters), *sums, *turns))
                    letters, sums, turns = [], [0, 0, 0], [None, None, 0]
                conv = c
                letters.append(letter)
                sums = [a + b for a, b in zip(sums, counts)]
                if turn is not None and turn != turns[1]:
                    turns = [turn if turns[0] is None else turns[0], turn, turns[2] + 1]
            if out:
                yield flushed()
                out.clear()
        if letters:
            out.append((conv, part, "".join(letters), *sums, *turns))
            yield flushed()

    # The order of the range exchange is that of its partitions, however many there are.
    order = ("conv", "turn", "digest")
    return symbols.repartitionByRange(*order).sortWithinPartitions(*order).drop("digest").mapInArrow(run, schema)


def report(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit)`` of each conversation.

    Rows are taken by turn, nulls first, rows of one turn by a hash of role and text.  A row's first
    fault counts: blank (only ASCII white space), duplicate (role and text of an earlier row), truncated
    (the last character that is no white space is none of ``.!?``).  ``gaps``: turns missing between
    the least and the greatest, null turns left out; ``illegal``: neighbours whose role initials are
    not su, ua or au.

    ``audit`` has a letter for each edit in order: Keep (cost 0), Rerole to user or assistant (2), Delete (3;
    needed for blank and duplicate rows) and Insert of an empty user or assistant row (2); truncated rows
    that stay cost 1.  The edits make the initials ``(s?(ua)+)?`` at the least ``cost``; of equal ones
    the ASCII-least.

    A null or empty role is no role of the pattern, a null role or text is one space; rows with a null
    ``conv_id`` are one conversation; an empty table gives no rows; further columns are not looked at.
    """
    rows = _rows(conversations, conv_id, turn, role, text)
    parts = _parts(_symbols(rows))
    whole = parts.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct(*parts.columns[1:]))).alias("parts"))
    fields = [(c, T.LongType()) for c in ("gaps", *_COUNTS, "illegal", "cost")]
    schema = T.StructType([T.StructField(conv_id, parts.schema["conv"].dataType), *(T.StructField(*f) for f in fields), T.StructField("audit", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = tables()
        for batch in batches:
            found = []
            for parts in batch.column(1):
                parts = parts.as_py()
                letters = np.frombuffer("".join(p["letters"] for p in parts).encode(), np.uint8)
                ranges = [(p["low"], p["high"], p["turns"]) for p in parts if p["low"] is not None]
                # A turn may lie on both sides of a cut.
                shared = sum(a[1] == b[0] for a, b in zip(ranges, ranges[1:]))
                gaps = ranges[-1][1] - ranges[0][0] + 1 - sum(r[2] for r in ranges) + shared if ranges else 0
                counts = [sum(p[c] for p in parts) for c in _COUNTS]
                found.append((gaps, *counts, illegal_pairs(letters), *known.repair(symbol_numbers(letters))))
            columns = list(zip(*found)) or [()] * 7
            arrays = [pa.array(c, pa.string() if k == 6 else pa.int64()) for k, c in enumerate(columns)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=schema.names)

    return whole.mapInArrow(run, schema)


def repaired(
    conversations: DataFrame, reports: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """``(conv_id, seq, edit, role, text)``: the rows that the edits of :func:`report` leave, ``seq`` from 0.

    A conversation's rows lie together and in order, and pass one at a time through one task (what
    reads them in order, like a digest, needs no further shuffle).
    """
    rows = _rows(conversations, conv_id, turn, role, text).select("conv", F.lit(1).alias("part"), "turn", "digest", "role", "text")
    edits = reports.select(
        F.col(f"`{conv_id}`").alias("conv"), F.lit(0).alias("part"), F.lit(None).cast("long").alias("turn"),
        F.lit(None).cast("string").alias("digest"), F.lit("").alias("role"), F.col("audit").alias("text"),
    )
    fields = [("seq", T.LongType()), ("edit", T.StringType()), ("role", T.StringType()), ("text", T.StringType())]
    schema = T.StructType([T.StructField(conv_id, rows.schema["conv"].dataType), *(T.StructField(*f) for f in fields)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, audit, at, state, seq = None, "", 0, START, 0

        def inserted(out: list) -> None:
            nonlocal at, state, seq
            while at < len(audit) and audit[at] == "I":
                state = MADE[state]
                out.append((conv, seq, "I", ROLES[state], ""))
                at, seq = at + 1, seq + 1

        for batch in batches:
            out: list = []
            for c, part, role, text in zip(*(batch.column(n).to_pylist() for n in ("conv", "part", "role", "text"))):
                if part == 0:
                    conv, audit, at, state, seq = c, text, 0, START, 0
                    inserted(out)
                    continue
                edit, at = audit[at], at + 1
                if edit != "D":
                    kept = KEPT[state]["sua".find(role[:1]) if role else 3] if edit == "K" else None
                    state = MADE[state] if kept is None else kept
                    out.append((conv, seq, edit, role if edit == "K" else ROLES[state], text))
                    seq += 1
                inserted(out)
            if out:
                columns = zip(zip(*out), (batch.column(0).type, pa.int64(), pa.string(), pa.string(), pa.string()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in columns], names=schema.names)

    both = edits.unionByName(rows).repartition("conv").sortWithinPartitions("conv", "part", "turn", "digest")
    return both.select("conv", "part", "role", "text").mapInArrow(run, schema)


def digests(rows: DataFrame, conv_id: str = "conv_id", name: str = "repaired_sha256") -> DataFrame:
    """``(conv_id, SHA-256 of the lines role:text)`` of rows as :func:`repaired` gives them."""
    schema = T.StructType([rows.schema[conv_id], T.StructField(name, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, running, kind, out = None, None, None, []

        def flushed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (kind, pa.string()))], names=schema.names)

        for batch in batches:
            kind = batch.column(0).type
            for c, seq, role, text in zip(*(batch.column(n).to_pylist() for n in (conv_id, "seq", "role", "text"))):
                if seq == 0:
                    if running is not None:
                        out.append((conv, running.hexdigest()))
                    conv, running = c, hashlib.sha256()
                else:
                    running.update(b"\n")
                running.update(f"{role}:{text}".encode())
            if out:
                yield flushed()
                out.clear()
        if running is not None:
            out.append((conv, running.hexdigest()))
            yield flushed()

    return rows.select(conv_id, "seq", "role", "text").mapInArrow(run, schema)


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows with planted faults, by ``crc32(conv_id:turn) % 20``; nulls are one space, also in that text.

    0 drops a row, 1 empties its text, 2 takes ``.!?`` from it, 3 repeats the row, 4 makes its role user.
    """
    name = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    fault = F.crc32(name) % 20
    text, role = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("text", "role"))
    rows = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), fault.alias("fault")).where("fault != 0")
    return rows.select(
        "conv_id",
        "turn",
        F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    ).drop("copy")


def audit_of_damaged(conversations: DataFrame) -> DataFrame:
    """Reports and digests of the damaged conversations, a row for every ``conv_id`` of ``conversations``."""
    rows = damaged(conversations)
    reports = cut(report(rows))
    lines = digests(repaired(rows, reports))
    every = conversations.select("conv_id").distinct()
    joined = every.join(reports, every["conv_id"].eqNullSafe(reports["conv_id"]), "left").drop(reports["conv_id"])
    joined = joined.join(lines, joined["conv_id"].eqNullSafe(lines["conv_id"]), "left").drop(lines["conv_id"])
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("gaps", *_COUNTS, "illegal", "cost")]
    empty = F.lit(hashlib.sha256().hexdigest())
    return joined.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", empty).alias("repaired_sha256"))


#: CRC-32 of a short ASCII text, bit by bit.
_CRC32 = """xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT),
    list_transform(range(1, len({0}) + 1), lambda k: CAST(ascii({0}[k]) AS BIGINT))),
    lambda c, b: list_reduce(list_prepend(xor(c, b), [CAST(0 AS BIGINT) FOR k IN range(8)]),
    lambda x, y: CASE WHEN (x & 1) = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)))"""

#: The contract in SQL: costs of the rest from the last row to the first, then edits from the first to the last.
ORACLE = f"""
WITH RECURSIVE input AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
           {_CRC32.format("name")} % 20 AS fault
    FROM (SELECT *, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name FROM conversations)),
damaged AS (
    SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
           CASE WHEN fault = 1 THEN '' WHEN fault = 2 THEN translate(text, '.!?', '') ELSE text END AS text,
           unnest(CASE WHEN fault = 3 THEN [0, 1] ELSE [0] END) AS copy
    FROM input WHERE fault <> 0),
numbered AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(role) || ':' || role || text)) AS i,
           rtrim(text, E' \t\n\x0b\x0c\r') AS body, left(role, 1) AS kind FROM damaged),
judged AS (
    SELECT *, CASE WHEN body = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
                   WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
           lag(kind) OVER (PARTITION BY conv_id ORDER BY i) || kind AS pair FROM numbered),
rows_ AS (SELECT *, fault IN ('blank', 'duplicate') AS gone, CAST(fault = 'truncated' AS INTEGER) AS extra FROM judged),
counted AS (
    SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
           count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
           count(*) FILTER (i > 1 AND pair NOT IN ('su', 'ua', 'au')) AS illegal FROM rows_ GROUP BY conv_id),
rest(conv_id, i, none, system, usr, assistant) AS (
    SELECT conv_id, n + 1, 0, 4, 2, 0 FROM counted
    UNION ALL
    SELECT conv_id, i, least(none, 2 + least(usr, 2 + assistant)), least(system, 2 + least(usr, 2 + assistant)),
           least(usr, 2 + assistant), least(assistant, 2 + usr)
    FROM (SELECT r.conv_id, r.i,
                 CASE WHEN gone THEN 3 + none
                      ELSE least(3 + none, 2 + extra + usr, CASE kind WHEN 's' THEN extra + system WHEN 'u' THEN extra + usr ELSE 999999 END) END AS none,
                 CASE WHEN gone THEN 3 + system
                      ELSE least(3 + system, 2 + extra + usr, CASE kind WHEN 'u' THEN extra + usr ELSE 999999 END) END AS system,
                 CASE WHEN gone THEN 3 + usr
                      ELSE least(3 + usr, 2 + extra + assistant, CASE kind WHEN 'a' THEN extra + assistant ELSE 999999 END) END AS usr,
                 CASE WHEN gone THEN 3 + assistant
                      ELSE least(3 + assistant, 2 + extra + usr, CASE kind WHEN 'u' THEN extra + usr ELSE 999999 END) END AS assistant
          FROM rest JOIN rows_ r ON rest.conv_id IS NOT DISTINCT FROM r.conv_id AND r.i = rest.i - 1)),
costs AS (SELECT conv_id, i, [none, system, usr, assistant] AS c FROM rest),
walk(conv_id, i, state, audit, lines) AS (
    SELECT conv_id, CAST(1 AS BIGINT), 1, '', CAST([] AS VARCHAR[]) FROM counted
    UNION ALL
    SELECT conv_id, CASE WHEN edit = 'I' THEN i ELSE i + 1 END,
           CASE edit WHEN 'D' THEN state WHEN 'K' THEN kept ELSE made END, audit || edit,
           CASE edit WHEN 'D' THEN lines WHEN 'K' THEN list_append(lines, role || ':' || text)
                ELSE list_append(lines, CASE made WHEN 3 THEN 'user:' ELSE 'assistant:' END || CASE edit WHEN 'R' THEN text ELSE '' END) END
    FROM (SELECT *, CASE WHEN role IS NOT NULL AND here[state] = 3 + after[state] THEN 'D' WHEN here[state] = 2 + here[made] THEN 'I'
                         WHEN NOT gone AND kept > 0 AND here[state] = extra + after[kept] THEN 'K' ELSE 'R' END AS edit
          FROM (SELECT w.*, a.c AS here, b.c AS after, r.role, r.text, r.gone, r.extra, CASE state WHEN 3 THEN 4 ELSE 3 END AS made,
                       CASE WHEN state = 1 AND r.kind = 's' THEN 2 WHEN state <> 3 AND r.kind = 'u' THEN 3 WHEN state = 3 AND r.kind = 'a' THEN 4 ELSE 0 END AS kept
                FROM walk w JOIN costs a ON w.conv_id IS NOT DISTINCT FROM a.conv_id AND w.i = a.i
                LEFT JOIN costs b ON w.conv_id IS NOT DISTINCT FROM b.conv_id AND b.i = w.i + 1
                LEFT JOIN rows_ r ON w.conv_id IS NOT DISTINCT FROM r.conv_id AND r.i = w.i
                WHERE r.role IS NOT NULL OR state IN (2, 3)))),
done AS (SELECT w.conv_id, audit, lines FROM walk w JOIN counted c ON w.conv_id IS NOT DISTINCT FROM c.conv_id
         WHERE w.i = n + 1 AND state IN (1, 4))
SELECT e.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, coalesce(c[1], 0) AS cost, coalesce(audit, '') AS audit,
       sha256(coalesce(array_to_string(lines, E'\n'), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) e LEFT JOIN counted n ON e.conv_id IS NOT DISTINCT FROM n.conv_id
LEFT JOIN costs k ON e.conv_id IS NOT DISTINCT FROM k.conv_id AND k.i = 1 LEFT JOIN done d ON e.conv_id IS NOT DISTINCT FROM d.conv_id"""
