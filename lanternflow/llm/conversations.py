"""Repair of conversations by a square-root checkpointed dynamic programme.

A conversation is legal if the initials of its roles read ``(s?(ua)+)?``: an optional system turn,
then user and assistant in turn. Four states follow from that: nothing yet, after the system turn,
after a user, after an assistant. ``Keep`` costs 0, ``Rerole`` (to user or assistant) 2, ``Delete`` 3,
``Insert`` (an empty user or assistant turn) 2; a truncated turn that stays adds 1; blank and duplicate
turns must go. What is inserted or reroled follows from the state, so a state-cost vector has four numbers.

A task reads every conversation twice from one sorted partition: first its faults and initials from
the last turn to the first, then its turns from the first to the last. The backward reading keeps the
cost vector only at checkpoints, whose distance doubles when they become too many: about the square root
of the turns. The forward reading holds the turns of one block, recomputes the block's vectors from the
checkpoint at its end, and emits the ASCII-least tight edit of each turn. So a conversation of any length
needs memory for the square root of its turns and for what it returns.

All turns of a conversation go through one task, as the digest of its repaired text is one SHA-256.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPACE = " \t\n\x0b\x0c\r"
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
NEVER = 1 << 62
OK, BLANK, DUPLICATE, CUT = range(4)
OWED = (2, 2, 3, 2)                                      # state after the turn that a state asks for
KEPT = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}  # initial: state before -> state after
ROLE_OF = {2: "user", 3: "assistant"}
LEGAL_PAIRS = {"su", "ua", "au"}
MOST = (1 << 63) - 1


def _with_inserts(start: int, system: int, user: int, assistant: int) -> tuple[int, int, int, int]:
    user, assistant = min(user, assistant + INSERT), min(assistant, user + INSERT)
    return min(start, user + INSERT), min(system, user + INSERT), user, assistant


END = _with_inserts(0, NEVER, NEVER, 0)


def before(after: tuple, fault: int, initial: str) -> tuple[int, int, int, int]:
    """Least cost to finish from each state in front of a turn, from the costs behind it."""
    cost = [x + DELETE for x in after]
    if fault not in (BLANK, DUPLICATE):
        stay = TRUNCATED if fault == CUT else 0
        kept = KEPT.get(initial, {})
        for s in range(4):
            cost[s] = min(cost[s], after[OWED[s]] + REROLE + stay)
            if s in kept:
                cost[s] = min(cost[s], after[kept[s]] + KEEP + stay)
    return _with_inserts(*cost)


class Checkpoints:
    """Backward cost vectors at every ``every``-th turn from the end; ``every`` grows with the root of the turns."""

    def __init__(self):
        self.every, self.turns, self.at, self.marks = 4, 0, END, {0: END}

    def push(self, fault: int, initial: str) -> None:
        self.turns += 1
        self.at = before(self.at, fault, initial)
        if self.turns % self.every == 0:
            self.marks[self.turns] = self.at
            if len(self.marks) > 2 * self.every:
                self.every *= 2
                self.marks = {j: f for j, f in self.marks.items() if j % self.every == 0}


class Repair:
    """Edits of one conversation: ``back`` takes its turns in reverse, then ``forward`` in order."""

    def __init__(self):
        self.plan, self.state, self.left, self.block = Checkpoints(), 0, None, []

    def back(self, fault: int, initial: str) -> None:
        self.plan.push(fault, initial)

    @property
    def cost(self) -> int:
        return self.plan.at[0]

    def forward(self, role: str, text: str, fault: int) -> Iterator[tuple[str, str | None, str | None]]:
        """(edit, role, text) of the turns that can be settled; role and text are those after it."""
        self.left = self.plan.turns if self.left is None else self.left
        self.block.append((role, text, fault))
        ahead = self.left - len(self.block)
        if ahead % self.plan.every == 0:
            vectors = [self.plan.marks[ahead]]
            for r, _, f in reversed(self.block):
                vectors.append(before(vectors[-1], f, r[:1]))
            for turn in self.block:
                now = vectors.pop()
                yield from self._settle(turn, now, vectors[-1])
            self.left, self.block = ahead, []

    def end(self) -> Iterator[tuple[str, str | None, str | None]]:
        while END[self.state]:
            self.state = OWED[self.state]
            yield "I", ROLE_OF[self.state], ""

    def _settle(self, turn: tuple, now: tuple, after: tuple):
        role, text, fault = turn
        stay = TRUNCATED if fault == CUT else 0
        while True:  # D, I, K, R in ASCII order; an edit is tight if the rest costs as little as it may
            s, cost = self.state, now[self.state]
            if after[s] + DELETE == cost:
                yield "D", None, None
                return
            if now[OWED[s]] + INSERT == cost:
                self.state = OWED[s]
                yield "I", ROLE_OF[self.state], ""
                continue
            to = KEPT.get(role[:1], {}).get(s)
            if to is not None and after[to] + KEEP + stay == cost:
                self.state = to
                yield "K", role, text
            else:
                self.state = OWED[s]
                yield "R", ROLE_OF[self.state], text
            return


# On Spark --------------------------------------------------------------------------------

def _given(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(" "))


def damaged(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, copy, gone`` after a repeatable damage of ``rows(conv_id, turn, role, text)``.

    crc32 of ``conv_id:turn`` modulo 20 chooses it: 0 drops the turn (``gone``), 1 empties its text, 2 takes
    out ``.!?``, 3 repeats it, 4 makes its role ``user``. Nulls count as one space.
    """
    kind = F.crc32(F.encode(F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]), "UTF-8")) % 20
    text = F.when(kind == 1, F.lit("")).when(kind == 2, F.translate(_given("text"), ".!?", "")).otherwise(_given("text"))
    role = F.when(kind == 4, F.lit("user")).otherwise(_given("role"))
    copies = F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("copy"), (kind == 0).alias("gone"))


def _readings(turns: DataFrame) -> DataFrame:
    """Each conversation in one partition: gone turns, then faults from the last to the first, then turns in order."""
    rows = turns.select("conv_id", "turn", F.when(_given("role") == "", F.lit(" ")).otherwise(_given("role")).alias("role"),
                        _given("text").alias("text"), "copy", "gone").repartition("conv_id")
    order = [F.col("turn").asc_nulls_first(), "role", "text", "copy"]
    seen = F.row_number().over(Window.partitionBy("conv_id", "gone", "role", "text").orderBy(F.col("turn").asc_nulls_first(), "copy"))
    end = F.rtrim(F.col("text"), F.lit(SPACE))
    fault = (F.when(end == "", F.lit(BLANK)).when(F.col("_seen") > 1, F.lit(DUPLICATE))
             .when(F.substring(end, -1, 1).isin(".", "!", "?"), F.lit(OK)).otherwise(F.lit(CUT)))
    place = F.row_number().over(Window.partitionBy("conv_id", "gone").orderBy(*order)).cast("long")
    ranked = rows.withColumn("_seen", seen).withColumn("fault", fault).withColumn("_place", place)
    kinds = F.when(F.col("gone"), F.array(F.lit(0))).otherwise(F.array(F.lit(1), F.lit(2)))
    return (ranked.withColumn("kind", F.explode(kinds))
            .withColumn("_key", F.when(F.col("kind") == 1, -F.col("_place")).otherwise(F.col("_place")))
            .withColumn("text", F.when(F.col("kind") == 2, F.col("text")))
            .sortWithinPartitions("conv_id", "kind", "_key").select("conv_id", "turn", "role", "text", "fault", "kind"))


class _Audit:
    """What is told of a whole conversation."""

    def __init__(self, conv_id):
        self.conv_id, self.repair = conv_id, Repair()
        self.faults, self.illegal, self.distinct, self.low, self.high, self.initial = [0] * 4, 0, 0, None, None, None
        self.edits, self.hash, self.empty = bytearray(), hashlib.sha256(), True

    def turn(self, turn, role: str, fault: int) -> None:
        self.faults[fault] += 1
        if self.initial is not None:
            self.illegal += self.initial + role[:1] not in LEGAL_PAIRS
        self.initial = role[:1]
        if turn is not None and turn != self.high:  # turns come in ascending order
            self.low = turn if self.low is None else self.low
            self.high = turn
            self.distinct += 1

    def edit(self, letter: str, role, text) -> None:
        self.edits += letter.encode()
        if role is not None:
            self.hash.update(f"{'' if self.empty else chr(10)}{role}:{text}".encode())
            self.empty = False

    def row(self) -> tuple:
        gaps = min(self.high - self.low + 1 - self.distinct, MOST) if self.distinct else 0
        return (self.conv_id, gaps, self.faults[BLANK], self.faults[DUPLICATE], self.faults[CUT], self.illegal,
                self.repair.cost, self.edits.decode(), self.hash.hexdigest())


def _walk(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[_Audit, int | None, tuple | None]]:
    """(audit, turn at hand, edit) in order; edit is None when a conversation is complete."""
    now = None

    def ended():
        for e in now.repair.end():
            now.edit(*e)
            yield now, None, e
        yield now, None, None

    for batch in batches:
        for conv_id, turn, role, text, fault, kind in zip(*[batch.column(c).to_pylist() for c in (
                "conv_id", "turn", "role", "text", "fault", "kind")]):
            if now is None or conv_id != now.conv_id:
                if now is not None:
                    yield from ended()
                now = _Audit(conv_id)
            if kind == 1:
                now.repair.back(fault, role[:1])
            elif kind == 2:
                now.turn(turn, role, fault)
                for e in now.repair.forward(role, text, fault):
                    now.edit(*e)
                    yield now, turn, e
    if now is not None:
        yield from ended()


AUDIT = pa.schema([("conv_id", pa.int64()), *[(c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
                   ("audit", pa.string()), ("repaired_sha256", pa.string())])
EDITS = pa.schema([("conv_id", pa.int64()), ("step", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])


def _in_batches(rows: Iterable[tuple], schema: pa.Schema, most: int = 4096, letters: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += sum(len(x) for x in r if isinstance(x, str))
        if len(held) >= most or size >= letters:
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def _marked(turns: DataFrame) -> DataFrame:
    for c, value in (("copy", F.lit(0)), ("gone", F.lit(False))):
        if c not in turns.columns:
            turns = turns.withColumn(c, value)
    return turns


def audit_conversations(turns: DataFrame) -> DataFrame:
    """One row for each conv_id of ``turns(conv_id, turn, role, text[, copy, gone])``: faults and cheapest repair.

    Columns: ``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256``.
    Turns are taken by ``turn`` (nulls first); equal ones by role, text and copy. The first
    fault of a turn counts: blank, duplicate (role and text seen earlier in it), truncated.
    A null role or text, and an empty role, count as one space; a null conv_id is one more conversation. Repeated
    rows are duplicates. ``gone`` rows only make sure that their conversation is returned; without turns
    all counts are 0 and the audit is empty. An empty table gives no row. Other columns are not read.
    ``gaps`` ends at 2^63-1; an audit holds at most 2^31 edits (one string).
    """
    def run(batches):
        yield from _in_batches((a.row() for a, _, e in _walk(batches) if e is None), AUDIT)

    return _readings(_marked(turns)).mapInArrow(
        run, "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")


def repair_conversations(turns: DataFrame) -> DataFrame:
    """The edits themselves: ``conv_id, step, edit, role, text``; a deleted turn has neither role nor text.

    Same turns and rules as ``audit_conversations``; ``step`` counts the edits of a conversation from 0.
    """
    def run(batches):
        yield from _in_batches(((a.conv_id, len(a.edits) - 1, *e) for a, _, e in _walk(batches) if e is not None), EDITS)

    return _readings(_marked(turns)).mapInArrow(run, "conv_id long, step long, edit string, role string, text string")
