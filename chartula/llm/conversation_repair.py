"""Repair of conversation structure: the cheapest edits that make the roles fit ``(s?(ua)+)?``.

A generalised LR parser reads the rows of a conversation in turn. Its grammar is

    conversation -> (empty) | opening turns      opening -> (empty) | s      turns -> pair | turns pair      pair -> u a

With all reductions done as soon as they can be, a stack ends in one of four states, and what may follow only
depends on that state. Every row may be kept, deleted or get another role, and rows may be inserted, so the
parser is in several stacks at once: a graph-structured stack, in which stacks with equal tops merge to the one
of least (cost, audit). At the end of a row no audit begins with another one, so the order of two audits never
changes when both are continued; that makes merging right, and parsing associative: a part of a conversation
is parsed from every top it may find, and parts are joined afterwards. Long conversations are so split over many
tasks: rows are sorted into ranges, every Arrow batch gives one part a conversation, and parts are folded in turn.
Only the digest of a whole repaired conversation has to pass through one task, as a stream.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartula.operators.joins import salted_join

WHITE_SPACE = " \t\n\x0b\x0c\r"
START, OPENED, USER, TURNS = range(4)
#: Top of a stack and role initial to the new top, with the reductions that follow.
SHIFT = {(START, "s"): OPENED, (START, "u"): USER, (OPENED, "u"): USER, (USER, "a"): TURNS, (TURNS, "u"): USER}
#: The top after the one of u and a that a top allows.
NEXT = {top: SHIFT.get((top, "u"), SHIFT.get((top, "a"))) for top in (START, OPENED, USER, TURNS)}
ACCEPTED = (START, TURNS)
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: Longest pattern that is parsed row by row, and remembered; longer ones are joined from halves.
PATTERN = 64
KEY = ["no_id", "conv"]
ORDER = [*KEY, "turn", "role", "h1", "h2"]
COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
PART_SCHEMA = (
    "no_id boolean, conv long, part long, blank long, duplicate long, truncated long, illegal long, turns long, low long, high long, "
    "first_turn long, last_turn long, first string, last string, paths array<struct<entry: int, exit: int, cost: long, audit: string>>"
)
AUDIT_SCHEMA = "no_id boolean, conv long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
EDITED_SCHEMA = "conv_id long, position long, edit string, role string, text string"

Stacks = dict[int, tuple[int, str]]


def _merge(stacks: Stacks, top: int, cost: int, audit: str) -> None:
    if top not in stacks or (cost, audit) < stacks[top]:
        stacks[top] = (cost, audit)


def with_inserts(stacks: Stacks) -> Stacks:
    """The stacks after any useful inserts: two lead from anywhere to anywhere they can lead."""
    reached = dict(stacks)
    for _ in range(2):
        for top, (cost, audit) in list(reached.items()):
            _merge(reached, NEXT[top], cost + INSERT, audit + "I")
    return reached


def parsed(stacks: Stacks, symbol: str) -> Stacks:
    """The stacks after one more row: ``d`` has to be deleted, a capital is the initial of a truncated row."""
    after: Stacks = {}
    for top, (cost, audit) in with_inserts(stacks).items():
        _merge(after, top, cost + DELETE, audit + "D")
        if symbol != "d":
            more = TRUNCATED if symbol.isupper() else 0
            if (kept := SHIFT.get((top, symbol.lower()))) is not None:
                _merge(after, kept, cost + more, audit + "K")
            _merge(after, NEXT[top], cost + more + REROLE, audit + "R")
    return after


@lru_cache(maxsize=1 << 14)
def _short(pattern: str, entry: int) -> tuple:
    stacks = {entry: (0, "")}
    for symbol in pattern:
        stacks = parsed(stacks, symbol)
    return tuple((top, *path) for top, path in stacks.items())


def paths(pattern: str, entry: int) -> list[tuple[int, int, str]]:
    """(top, cost, audit) for each top that the rows of ``pattern`` can lead to from the top ``entry``."""
    if len(pattern) <= PATTERN:
        return list(_short(pattern, entry))
    # Halves are joined, so that no long audit is copied for every row.
    half = 1 << ((len(pattern) - 1).bit_length() - 1)
    stacks: Stacks = {}
    for top, cost, audit in paths(pattern[:half], entry):
        for end, more, rest in paths(pattern[half:], top):
            _merge(stacks, end, cost + more, audit + rest)
    return [(top, *path) for top, path in stacks.items()]


class Fold:
    """The parts of one conversation, joined in turn. An audit is a chain of the parts' own audits, ranked among the others."""

    def __init__(self) -> None:
        self.tops: dict[int, tuple[int, int, tuple | None]] = {START: (0, 0, None)}
        self.counts = dict.fromkeys(["blank", "duplicate", "truncated", "illegal", "turns"], 0)
        self.low = self.high = self.last_turn = None
        self.last = ""

    def add(self, part: dict) -> None:
        for name in ("blank", "duplicate", "truncated", "illegal", "turns"):
            self.counts[name] += part[name]
        if not part["first"]:
            return
        self.counts["illegal"] += bool(self.last) and self.last + part["first"] not in ("su", "ua", "au")
        self.counts["turns"] -= part["first_turn"] is not None and part["first_turn"] == self.last_turn
        self.last, self.last_turn = part["last"], part["last_turn"]
        if part["low"] is not None:
            self.low = part["low"] if self.low is None else min(self.low, part["low"])
            self.high = part["high"] if self.high is None else max(self.high, part["high"])
        best: dict[int, tuple] = {}
        for path in part["paths"]:
            if path["entry"] in self.tops:
                cost, rank, chain = self.tops[path["entry"]]
                option = (cost + path["cost"], rank, path["audit"], chain)
                if path["exit"] not in best or option[:3] < best[path["exit"]][:3]:
                    best[path["exit"]] = option
        # Two chains of different ranks keep their order whatever follows.
        order = sorted({option[1:3] for option in best.values()})
        self.tops = {top: (cost, order.index((rank, audit)), (chain, audit)) for top, (cost, rank, audit, chain) in best.items()}

    def whole(self) -> dict:
        ends = {}
        for top, (cost, rank, _) in self.tops.items():
            for end, (more, audit) in with_inserts({top: (0, "")}).items():
                if end in ACCEPTED:
                    ends[cost + more, rank, audit] = top
        (cost, _, rest), top = min(ends.items())
        pieces, chain = [rest], self.tops[top][2]
        while chain is not None:
            chain, audit = chain
            pieces.append(audit)
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.counts["turns"]
        return {"gaps": gaps, **{n: self.counts[n] for n in ("blank", "duplicate", "truncated", "illegal")}, "cost": cost, "audit": "".join(reversed(pieces))}


def _edge(values: np.ndarray, known: np.ndarray, at: int):
    return int(values[at]) if known[at] else None


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One part a conversation and Arrow batch. Only the first and the last one of a batch can go on elsewhere."""
    number, before = TaskContext.get().partitionId() << 32, None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        plain = {name: batch.column(name).to_numpy(zero_copy_only=False) for name in ("no_id", "conv", "here", "blank", "truncated", "later", "h1", "h2")}
        initials = np.frombuffer("".join(batch.column("initial").to_pylist()).encode(), np.uint8)
        known = batch.column("turn").is_valid().to_numpy(zero_copy_only=False)
        turn = batch.column("turn").fill_null(0).to_numpy()
        new = np.ones(n, bool)
        new[1:] = (plain["conv"][1:] != plain["conv"][:-1]) | (plain["no_id"][1:] != plain["no_id"][:-1])
        # Equal rows stand next to each other; all but the first are duplicates. A dropped row has no equals.
        names = ("no_id", "conv", "here", "h1", "h2")
        rows = np.flatnonzero(plain["here"])
        equal = np.zeros(n, bool)
        if len(rows):
            same = np.ones(len(rows) - 1, bool)
            for values in [plain[c] for c in names] + [known, turn]:
                same &= values[rows[1:]] == values[rows[:-1]]
            equal[rows[1:]] = same
            ends = [tuple([plain[c][r] for c in names] + [known[r], turn[r]]) for r in (rows[0], rows[-1])]
            equal[rows[0]] = ends[0] == before
            before = ends[1]
        blank = plain["blank"] & plain["here"]
        duplicate = (plain["later"] | equal) & plain["here"] & ~blank
        truncated = plain["truncated"] & plain["here"] & ~blank & ~duplicate
        symbols = np.where(blank | duplicate, ord("d"), np.where(truncated, initials - 32, initials))[rows].astype(np.uint8)
        begins = np.flatnonzero(new)
        at = np.searchsorted(rows, np.append(begins, n))
        legal = np.isin(initials[rows[:-1]].astype(int) << 8 | initials[rows[1:]], [ord(a) << 8 | ord(b) for a, b in ("su", "ua", "au")]) if len(rows) > 1 else np.zeros(0, bool)
        fresh = np.ones(len(rows), bool) & known[rows]
        fresh[1:] &= ~(known[rows[:-1]] & (turn[rows[1:]] == turn[rows[:-1]])) if len(rows) > 1 else True
        sums = {name: np.add.reduceat(values.astype(np.int64), begins) for name, values in (("blank", blank), ("duplicate", duplicate), ("truncated", truncated))}
        columns: dict[str, list] = {name: [] for name in ("illegal", "turns", "low", "high", "first_turn", "last_turn", "first", "last")}
        flat, sizes = [], []
        for k, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
            some = b > a
            times = turn[rows[a:b]][known[rows[a:b]]]
            columns["illegal"].append(max(0, b - a - 1) - int(legal[a : b - 1].sum()) if some else 0)
            columns["turns"].append(int(fresh[a + 1 : b].sum()) + int(known[rows[a]]) if some else 0)
            columns["low"].append(int(times.min()) if len(times) else None)
            columns["high"].append(int(times.max()) if len(times) else None)
            columns["first_turn"].append(_edge(turn, known, rows[a]) if some else None)
            columns["last_turn"].append(_edge(turn, known, rows[b - 1]) if some else None)
            columns["first"].append(chr(initials[rows[a]]) if some else "")
            columns["last"].append(chr(initials[rows[b - 1]]) if some else "")
            pattern = symbols[a:b].tobytes().decode()
            open_ended = some and k in (0, len(begins) - 1)
            found = [(entry, *path) for entry in ((START, OPENED, USER, TURNS) if open_ended else (START,)) for path in paths(pattern, entry)]
            flat += found
            sizes.append(len(found))
        path_type = pa.struct([("entry", pa.int32()), ("exit", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())])
        struct = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*flat, strict=True), path_type, strict=True)], fields=list(path_type))
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), struct)
        numbers = {name: pa.array(columns[name], pa.int64()) for name in ("illegal", "turns", "low", "high", "first_turn", "last_turn")}
        made = {
            "no_id": pa.array(plain["no_id"][begins]), "conv": pa.array(plain["conv"][begins]), "part": pa.array(number + np.arange(len(begins))),
            **{name: pa.array(values) for name, values in sums.items()}, **numbers, "first": pa.array(columns["first"]), "last": pa.array(columns["last"]), "paths": lists,
        }
        number += len(begins)
        yield pa.RecordBatch.from_pydict(made)


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key, fold, rows = None, None, []
    names = ["no_id", "conv", *COUNTS, "audit"]
    types = [pa.bool_(), pa.int64(), *[pa.int64()] * len(COUNTS), pa.string()]

    def made() -> pa.RecordBatch:
        columns = [pa.array([r[n] for r in rows], t) for n, t in zip(names, types, strict=True)]
        rows.clear()
        return pa.RecordBatch.from_arrays(columns, names)

    for batch in batches:
        for part in batch.to_pylist():
            if (part["no_id"], part["conv"]) != key:
                if fold is not None:
                    rows.append({"no_id": key[0], "conv": key[1], **fold.whole()})
                key, fold = (part["no_id"], part["conv"]), Fold()
            fold.add(part)
        if rows:
            yield made()
    if fold is not None:
        rows.append({"no_id": key[0], "conv": key[1], **fold.whole()})
        yield made()


class Editor:
    """Applies an audit to the rows of a conversation, in turn."""

    def __init__(self, audit: str):
        self.audit, self.at, self.last = audit, 0, ""

    def _given(self, edit: str, text: str) -> tuple[str, str, str]:
        role = "assistant" if self.last == "u" else "user"
        self.last = role[0]
        return edit, role, text

    def inserted(self) -> Iterator[tuple[str, str, str]]:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.at += 1
            yield self._given("I", "")

    def row(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        """Edit, role and text of the rows that come of one row."""
        yield from self.inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            self.last = role[:1]
            yield edit, role, text
        elif edit == "R":
            yield self._given(edit, text)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    waiting, done, editor, digest, empty = [], [], None, None, True

    def wrote(lines) -> None:
        nonlocal empty
        for _, role, text in lines:
            digest.update(f"{'' if empty else chr(10)}{role}:{text}".encode())
            empty = False

    def given(count: int) -> pa.RecordBatch:
        nonlocal waiting
        table = pa.Table.from_batches(waiting).combine_chunks()
        waiting = table.slice(count).to_batches()
        heads = table.slice(0, count)
        out = pa.RecordBatch.from_arrays([*[c.combine_chunks() if c.num_chunks != 1 else c.chunk(0) for c in heads.columns], pa.array(done[:count])], [*heads.schema.names, "repaired_sha256"])
        del done[:count]
        return out

    for batch in batches:
        heads = batch.column("is_row").to_numpy(zero_copy_only=False) == 0
        if heads.any():
            waiting.append(batch.filter(pa.array(heads)).select([*KEY, *COUNTS, "audit"]))
        audits = iter(batch.column("audit").filter(pa.array(heads)).to_pylist())
        for head, role, text in zip(heads.tolist(), batch.column("role").to_pylist(), batch.column("text").to_pylist(), strict=True):
            if head:
                if editor:
                    wrote(editor.inserted())
                    done.append(digest.hexdigest())
                editor, digest, empty = Editor(next(audits)), hashlib.sha256(), True
            else:
                wrote(editor.row(role, text))
        if done:
            yield given(len(done))
    if editor:
        wrote(editor.inserted())
        done.append(digest.hexdigest())
        yield given(len(done))


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    editor, key, place = None, None, 0
    names, types = ["conv_id", "position", "edit", "role", "text"], [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
    for batch in batches:
        rows: list[tuple] = []

        def put(lines) -> None:
            nonlocal place
            for line in lines:
                rows.append((key, place, *line))
                place += 1

        for is_row, no_id, conv, audit, role, text in zip(*[batch.column(c).to_pylist() for c in ("is_row", "no_id", "conv", "audit", "role", "text")], strict=True):
            if is_row:
                put(editor.row(role, text))
            else:
                if editor:
                    put(editor.inserted())
                editor, key, place = Editor(audit), None if no_id else conv, 0
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 5, types, strict=True)], names)
    if editor:
        rows = [(key, place + n, *line) for n, line in enumerate(editor.inserted())]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 5, types, strict=True)], names)


def damaged(conversations: DataFrame) -> DataFrame:
    """``conversations(conv_id, turn, role, text)`` with planted faults, chosen by crc32 of ``conv_id:turn`` modulo 20.

    0 drops a row, 1 empties its text, 2 removes its ``.!?``, 3 repeats it with the same turn, 4 makes it the
    user's. Nulls count as one space (a null turn or conv_id only in that key). Dropped rows stay with ``here``
    false, so that no conversation is lost.
    """
    written = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    code = F.pmod(F.crc32(F.concat(written[0], F.lit(":"), written[1]).cast("binary")), F.lit(20))
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), code.alias("code"))
    changed = F.when(F.col("code") == 1, "").when(F.col("code") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return rows.select(
        "conv_id", "turn", F.when(F.col("code") == 4, "user").otherwise(F.col("role")).alias("role"), changed.alias("text"),
        (F.col("code") != 0).alias("here"), F.explode(F.array_repeat(F.lit(0), F.when(F.col("code") == 3, 2).otherwise(1))).alias("copy"),
    ).drop("copy")


def _read(turns: DataFrame) -> DataFrame:
    """The rows with keys that put them in order; a missing ``here`` is true."""
    text, role = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("text", "role"))
    here = F.coalesce(F.col("here"), F.lit(True)) if "here" in turns.columns else F.lit(True)
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), here.alias("here"))
    hashes = [F.xxhash64(F.lit(n), "role", "text").alias(f"h{n}") for n in (1, 2)]
    return rows.select(F.col("conv_id").isNull().alias("no_id"), F.coalesce("conv_id", F.lit(0)).alias("conv"), "turn", "role", "text", "here", *hashes)


def _initial(role: Column) -> Column:
    first = F.substring(role, 1, 1)
    return F.when(first.isin("s", "u", "a"), first).otherwise("x")


def audits(turns: DataFrame) -> DataFrame:
    """Faults, cost and audit per conversation of ``turns(conv_id, turn, role, text[, here])``.

    Columns: no_id, conv (the id, 0 without one), gaps, blank, duplicate, truncated, illegal, cost, audit. Rows are
    taken by turn, nulls first, then role, then a hash of role and text; a null role or text is one space; rows
    whose ``here`` is false only name their conversation. Rows without a conv_id are one conversation. Roles are told
    by their first letter; an empty role fits nowhere. A conversation without rows has zeros and an empty audit, an empty table gives no rows;
    other columns are not read. Texts are not shuffled here, only their hashes.
    """
    trimmed = F.rtrim("text", F.lit(WHITE_SPACE))
    last = F.substring(trimmed, -1, 1)
    slim = _read(turns).select(
        *ORDER, "here", _initial(F.col("role")).alias("initial"), (trimmed == "").alias("blank"), (~last.isin(".", "!", "?")).alias("truncated")
    )
    # A row is a duplicate if its role and text occur at an earlier turn; the join only has texts of several turns.
    time = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    several = slim.filter("here").groupBy(*KEY, "h1", "h2").agg(F.min(time).alias("earliest"), F.max(time).alias("latest")).filter("earliest < latest").drop("latest")
    marked = salted_join(slim, several, [*KEY, "h1", "h2"], "left", salt_on=["turn"])
    later = F.coalesce(time > F.col("earliest"), F.lit(False)).alias("later")
    rows = marked.select(*ORDER, "here", "initial", "blank", "truncated", later)
    parts = rows.repartitionByRange(*ORDER).sortWithinPartitions(*ORDER).mapInArrow(_parts, PART_SCHEMA)
    return parts.repartition(*KEY).sortWithinPartitions(*KEY, "part").mapInArrow(_folded, AUDIT_SCHEMA)


def _beside(turns: DataFrame, found: DataFrame) -> DataFrame:
    """Each conversation's audit, then its rows in turn."""
    heads = found.withColumn("is_row", F.lit(0))
    rows = _read(turns).filter("here").drop("here").withColumn("is_row", F.lit(1))
    both = heads.unionByName(rows, allowMissingColumns=True)
    return both.repartition(*KEY).sortWithinPartitions(*KEY, "is_row", *ORDER[2:])


def repaired_digests(turns: DataFrame, found: DataFrame) -> DataFrame:
    """``found`` (of ``audits``) with repaired_sha256 of the repaired ``role:text`` lines; conv_id in place of its key.

    SHA-256 reads a conversation from first to last, so each one streams through one task; nothing is held.
    """
    whole = _beside(turns, found).mapInArrow(_digests, AUDIT_SCHEMA + ", repaired_sha256 string")
    return whole.select(F.when(~F.col("no_id"), F.col("conv")).alias("conv_id"), *COUNTS[:-1], "cost", "audit", "repaired_sha256")


def repaired_turns(turns: DataFrame, found: DataFrame) -> DataFrame:
    """conv_id, position (from 0), edit (K, R or I), role, text: the repaired rows under the audits ``found``."""
    return _beside(turns, found).mapInArrow(_edited, EDITED_SCHEMA)
