"""Conversation repair against a search over whole edit sequences that merges nothing."""

import hashlib
import heapq
import random
import re
import zlib
from itertools import count

import pytest

from chartula.llm import catalog, conversation_repair

SCHEMA = "conv_id long, turn long, role string, text string, cost int, audit string"
BLANK = " \t\n\x0b\x0c\r"


def damaged(rows):
    """Rows (conv_id, turn, role, text) as the contract damages them, in order, by conversation."""
    kept = {}
    for conv, turn, role, text in rows:
        role, text = (" " if v is None else v for v in (role, text))
        code = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        own = kept.setdefault(conv, [])
        if code:
            text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
            own += [(turn, "user" if code == 4 else role, text)] * (2 if code == 3 else 1)
    return kept


def marked(rows):
    """Rows with their first fault."""
    seen, out = set(), []
    for turn, role, text in rows:
        bare = text.rstrip(BLANK)
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
        seen.add((role, text))
        out.append((turn, role, text, fault))
    return out


def cheapest(rows, delete=2):
    """Least (cost, audit) and the repaired lines, by cost order over all edit sequences."""
    ticket = count()
    heap = [(0, "", next(ticket), 0, ())]
    while heap:
        cost, audit, _, at, lines = heapq.heappop(heap)
        initials = "".join(r[:1] or "-" for r, _ in lines)
        if not re.fullmatch("(s?(ua)*u?)?", initials):
            continue
        if at == len(rows) and re.fullmatch("(s?(ua)+)?", initials):
            return cost, audit, lines
        if audit[-2:] != "II":
            for role in ("user", "assistant"):
                heapq.heappush(heap, (cost + 5, audit + "I", next(ticket), at, (*lines, (role, ""))))
        if at < len(rows):
            _, role, text, fault = rows[at]
            heapq.heappush(heap, (cost + delete, audit + "D", next(ticket), at + 1, lines))
            if fault in ("", "truncated"):
                more = 5 * (fault == "truncated")
                heapq.heappush(heap, (cost + more, audit + "K", next(ticket), at + 1, (*lines, (role, text))))
                for other in ("user", "assistant"):
                    heapq.heappush(heap, (cost + more + 1, audit + "R", next(ticket), at + 1, (*lines, (other, text))))


def wanted(rows):
    out = {}
    for conv, own in damaged(rows).items():
        own = marked(sorted(own, key=lambda r: (r[0] is not None, r[0] or 0)))
        turns = [r[0] for r in own if r[0] is not None]
        initials = [r[1][:1] for r in own]
        cost, audit, lines = cheapest(own)
        out[conv] = (
            max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *[sum(r[3] == f for r in own) for f in ("blank", "duplicate", "truncated")],
            sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in lines).encode()).hexdigest(),
        )
    return out


def found(spark, rows, table=None):
    docs = spark.createDataFrame([(*r, 7, "x") for r in rows], SCHEMA) if table is None else table
    out = {}
    for r in catalog.op12(docs).collect():
        assert r.conv_id not in out
        out[r.conv_id] = (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256)
    return out


def conversations(seed, many, most=7):
    draw = random.Random(seed)
    rows = []
    for conv in range(many):
        turn = draw.randrange(-2, 3)
        for _ in range(draw.randrange(1, most)):
            turn += draw.choice([1, 1, 1, 2, 3])
            role = draw.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "sage"])
            rows.append((conv, turn, role, draw.choice(["Yes.", "No!", "a b", "", " \n", None, "Why?  ", "end. x", f"text {turn}."])))
    return rows


def test_random_conversations(spark):
    rows = conversations(1, 400)
    want = wanted(rows)
    got = found(spark, rows)
    assert got == want
    assert {c for w in want.values() for c in w[6]} == set("KDR")  # at these costs a delete is always cheaper than an insert


def test_odd_rows(spark):
    rows = [(None, None, None, None), (None, 3, "user", "Hi."), (5, None, "user", "Only."), (6, None, "assistant", "x."), (7, 2**62, "user", "y" * 200_000 + "."), (7, 2**62 + 1, "assistant", " " * 300_000)]
    lost = next(n for n in range(1000, 2000) if zlib.crc32(f"{n}:0".encode()) % 20 == 0)
    rows.append((lost, 0, "user", "All of it is dropped."))
    got = found(spark, rows)
    assert got == wanted(rows)
    assert got[lost] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert found(spark, rows, spark.createDataFrame([], SCHEMA)) == {}


def test_repeated_rows_and_ties(spark):
    rows = [(1, 4, "user", "Same."), (1, 4, "user", "Same."), (1, 4, "assistant", "Other."), (1, 5, "assistant", "Same."), (1, 6, "user", "Same.")]
    got, again = found(spark, rows), found(spark, rows[::-1])
    assert got == again
    kept = sum(len(v) for v in damaged(rows).values())
    assert len(got[1][6].replace("I", "")) == kept


@pytest.mark.parametrize("batch", [3, 50])
def test_long_conversations_in_parts(spark, batch, monkeypatch):
    """Parts of a few rows over many partitions give what one pass over all rows gives."""
    draw = random.Random(batch)
    rows = [(n % 2, n, draw.choice(["user", "assistant", "system", "tool"]), draw.choice(["Yes.", "No.", "x", "", f"t{n}."])) for n in range(1200)]
    want = {}
    for conv, own in damaged(rows).items():
        own = marked(own)
        fold = {conversation_repair.START: (0, "")}
        for _, role, _, fault in own:
            initial = role[0] if role[0] in "sua" else "x"
            fold = conversation_repair.parsed(fold, "d" if fault in ("blank", "duplicate") else initial.upper() if fault else initial)
        want[conv] = min(path for top, path in conversation_repair.with_inserts(fold).items() if top in conversation_repair.ACCEPTED)
    old = {k: spark.conf.get(k) for k in ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    for key, value in zip(old, (str(batch), "13", "false"), strict=True):
        spark.conf.set(key, value)
    try:
        got = found(spark, rows)
    finally:
        for key, value in old.items():
            spark.conf.set(key, value)
    assert {conv: g[5:7] for conv, g in got.items()} == want


def test_halves_are_joined():
    draw = random.Random(2)
    for size in (1, 63, 64, 65, 200, 1000):
        pattern = "".join(draw.choice("suadSUAxX") for _ in range(size))
        for entry in range(4):
            stacks = {entry: (0, "")}
            for symbol in pattern:
                stacks = conversation_repair.parsed(stacks, symbol)
            assert {top: tuple(path) for top, *path in conversation_repair.paths(pattern, entry)} == stacks


def test_repaired_rows(spark):
    rows = conversations(9, 60)
    turns = conversation_repair.damaged(spark.createDataFrame([(*r, 7, "x") for r in rows], SCHEMA))
    lines = {}
    for r in sorted(conversation_repair.repaired_turns(turns, conversation_repair.audits(turns)).collect(), key=lambda r: (r.conv_id, r.position)):
        own = lines.setdefault(r.conv_id, [])
        assert r.position == len(own) and r.edit in "KRI"
        own.append((r.role, r.text))
    for conv, values in wanted(rows).items():
        own = lines.get(conv, [])
        assert hashlib.sha256("\n".join(f"{r}:{t}" for r, t in own).encode()).hexdigest() == values[-1]
        assert re.fullmatch("(s?(ua)+)?", "".join(r[:1] for r, _ in own))


def test_smallest_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    rows = [tuple(r) for r in table.select("conv_id", "turn", "role", "text").orderBy("conv_id", "turn").collect()]
    assert found(spark, rows, table) == wanted(rows)


def test_inserts_where_deletes_are_dear(monkeypatch):
    monkeypatch.setattr(conversation_repair, "DELETE", 9)
    conversation_repair._short.cache_clear()
    edits = set()
    for conv, own in damaged(conversations(4, 80, 6)).items():
        own = marked(own)
        fold = conversation_repair.Fold()
        symbols = ["d" if f in ("blank", "duplicate") else (r[:1] if r[:1] in ("s", "u", "a") else "x") for _, r, _, f in own]
        symbols = "".join(s.upper() if f == "truncated" else s for s, (*_, f) in zip(symbols, own, strict=True))
        for at in range(0, len(symbols), 2):
            given = [dict(zip(("entry", "exit", "cost", "audit"), (e, *p), strict=True)) for e in range(4) for p in conversation_repair.paths(symbols[at : at + 2], e)]
            fold.add({"blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "turns": 0, "first": "x", "last": "x", "first_turn": None, "last_turn": None, "low": None, "high": None, "paths": given})
        cost, audit, lines = cheapest(own, 9)
        whole = fold.whole()
        assert (whole["cost"], whole["audit"]) == (cost, audit)
        edits |= set(audit)
        editor, out = conversation_repair.Editor(audit), []
        for _, role, text, _ in own:
            out += editor.row(role, text)
        out += editor.inserted()
        assert [line[1:] for line in out] == list(lines)
    conversation_repair._short.cache_clear()
    assert edits == set("KDRI")
