"""Conversation structure repair: the cheapest edits that give every conversation the shape ``(s?(ua)+)?``.

Equal rows of one turn are first aggregated to one row with a count, and the first occurrence of each message is found by
a grouping, so later copies are known as duplicates without a conversation's messages being held anywhere. Then two
passes stream each conversation through one task, sorted by turn, whatever its length:

1. backwards: the dynamic programme over the four states of the shape (start, after system, after user, after
   assistant). A task carries the four costs from batch to batch and writes one byte per row, the best edit in each
   state, to a table in the shared folder. These are the back pointers; none are held in memory.
2. forwards: from the start state the bytes name the edits. A task carries state, counts and running digest.

Edits and costs: keep 0, rerole to user or assistant 1, delete 2, insert an empty message 5; a message that breaks off
and is not deleted costs 5 more. Blank and duplicate messages must be deleted. Of equally cheap lists of edits the least
in ASCII order of their initials wins; it is unique, as state and initial fix the next state.

Defined results: null roles and texts count as one space; null turns come first; a null conversation is a conversation;
rows of one turn go by role, then text; repeated rows are duplicates; texts of any length are read whole; an empty table
gives an empty result; further columns are not carried. A conversation's list of edits is one value and must fit a task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gearsight.llm.common import attach, col, stage

BLANKS = " \t\n\x0b\x0c\r"
KEEP, REROLE, DELETE, INSERT, BROKEN = 0, 1, 2, 5, 5
#: By state (start, after system, after user, after assistant): the role that an insert or rerole gives, and what follows.
GIVES = ("user", "user", "assistant", "user")
NEXT = (2, 2, 3, 2)
#: Edits in the order of their initials.
EDITS = "DIKR"
ENDS = (0, 3)
#: Class of a role by its initial; other roles cannot stay.
CLASSES = {"s": 0, "u": 1, "a": 2}
#: A row's kind: 0 must go, else 1 + 2 * class (0 to 3) + whether it breaks off.
FORCED = 0
LEGAL = {"su", "ua", "au"}
ORDER = ("turn", "role", "text")
TURNS = "conv_id {kind}, at long, turn {turn}, edit string, role string, text string"
REPORT = ("conv_id {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
          "repaired_sha256 string")


def after_keep(state: int, role: int) -> int | None:
    """State after a message of this class is kept; None if it may not stand here."""
    if role == 0:
        return 1 if state == 0 else None
    return NEXT[state] if role in (1, 2) and GIVES[state] == ("user", "assistant")[role - 1] else None


def closed(costs: list[int]) -> tuple[int, ...]:
    """Costs to the end when messages may be inserted first."""
    out = list(costs)
    for state in (2, 3, 2, 1, 0):
        out[state] = min(out[state], INSERT + out[NEXT[state]])
    return tuple(out)


#: Costs to the end when no row is left.
LAST = closed([0 if s in ENDS else 1 << 40 for s in range(4)])


class Steps(dict):
    """(kind, costs after the row, less their smallest) -> (costs before it, less their smallest, best edits as a byte)."""

    def __missing__(self, key: tuple[int, tuple[int, ...]]) -> tuple[tuple[int, ...], int]:
        kind, after = key
        role, broken = divmod(kind - 1, 2)
        options = []
        for state in range(4):
            found = {"D": DELETE + after[state]}
            if kind != FORCED:
                found["R"] = REROLE + BROKEN * broken + after[NEXT[state]]
                if (kept := after_keep(state, role)) is not None:
                    found["K"] = KEEP + BROKEN * broken + after[kept]
            options.append(found)
        before = closed([min(found.values()) for found in options])
        byte = 0
        for state, found in enumerate(options):
            found["I"] = INSERT + before[NEXT[state]]
            edit = min(e for e, cost in found.items() if cost == before[state])
            byte |= EDITS.index(edit) << 2 * state
        least = min(before)
        out = self[key] = (tuple(c - least for c in before), byte)
        return out


def with_faults(rows: DataFrame, names: tuple[str, str, str, str]) -> DataFrame:
    """One row for equal rows of a turn: conv, turn, role, text, copies, later (all are duplicates), kind, fault."""
    conv, turn, role, text = names
    kept = rows.select(col(conv).alias("conv"), col(turn).alias("turn"), F.coalesce(col(role), F.lit(" ")).alias("role"),
                       F.coalesce(col(text), F.lit(" ")).alias("text"))
    once = kept.groupBy("conv", *ORDER).agg(F.count(F.lit(1)).alias("copies"))
    same = F.unhex(F.sha2(F.concat_ws("\n", F.coalesce(F.concat(F.lit("="), F.col("conv").cast("string")), F.lit("")),
                                      F.length("role").cast("string"), "role", "text"), 256))
    place = F.struct(F.col("turn").isNotNull().alias("given"), F.col("turn").alias("turn"))
    keyed = stage(once.withColumn("same", same).withColumn("place", place), "messages")
    first = keyed.groupBy("same").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("weight"))
    again = first.filter(F.col("weight") > 1)
    spread = F.unhex(F.hex(F.xxhash64("conv", *ORDER)))
    met = attach(keyed, again, "same", "weight", keyed.count(), spread)
    body = F.rtrim(F.col("text"), F.lit(BLANKS))
    later = F.coalesce(F.col("place") > F.col("first"), F.lit(False))
    fault = (F.when(body == "", "blank").when(later, "duplicate")
             .when(~F.right(body, F.lit(1)).isin(".", "!", "?"), "truncated").otherwise(""))
    role_class = F.lit(3)
    for initial, value in CLASSES.items():
        role_class = F.when(F.left("role", F.lit(1)) == initial, value).otherwise(role_class)
    kind = F.when(F.col("fault").isin("blank", "duplicate"), FORCED).otherwise(
        1 + 2 * role_class + (F.col("fault") == "truncated").cast("int"))
    return met.withColumn("fault", fault).select("conv", *ORDER, "copies", "fault", kind.cast("int").alias("kind"))


def backwards(rows: DataFrame) -> DataFrame:
    """``rows`` with the byte ``best`` of each: the edit to choose in every state. Copies after the first are deleted in
    any state, which changes no choice before them."""
    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps, conv, costs, some = Steps(), None, LAST, False
        for batch in batches:
            out = []
            for c, kind in zip(batch.column("conv").to_pylist(), batch.column("kind").to_pylist()):
                if not some or c != conv:
                    conv, costs, some = c, LAST, True
                costs, byte = steps[kind, costs]
                out.append(byte)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int32())], [*batch.schema.names, "best"])

    order = [F.col("conv"), F.col("turn").desc_nulls_last(), F.col("role").desc(), F.col("text").desc()]
    return rows.repartition("conv").sortWithinPartitions(*order).mapInArrow(stream, T.StructType([*rows.schema, T.StructField("best", T.IntegerType())]))


class Walk:
    """One conversation, row by row in order: its edits, counts and digest."""

    def __init__(self, conv):
        self.conv, self.state, self.cost, self.at = conv, 0, 0, 0
        self.counts = {"blank": 0, "duplicate": 0, "truncated": 0}
        self.illegal, self.initial, self.turns, self.low, self.high = 0, None, 0, None, None
        self.audit: list[str] = []
        self.digest = hashlib.sha256()

    def edit(self, name: str, cost: int, role: str | None = None, text: str = "", turn=None, times: int = 1) -> tuple:
        self.audit.append(name * times)
        self.cost += cost * times
        if role is not None:
            self.digest.update((("\n" if self.at else "") + f"{role}:{text}").encode())
            self.at += 1
        return (self.conv, self.at - 1 if role is not None else None, turn, name, role, text if role is not None else None)

    def insert(self) -> tuple:
        role, self.state = GIVES[self.state], NEXT[self.state]
        return self.edit("I", INSERT, role)

    def row(self, turn, role: str, text: str, copies: int, fault: str, best: int) -> Iterator[tuple]:
        if turn is not None and (self.high is None or turn != self.high):
            self.low, self.high, self.turns = turn if self.low is None else self.low, turn, self.turns + 1
        if self.initial is not None:
            self.illegal += self.initial + role[:1] not in LEGAL
        self.initial = role[:1]
        self.illegal += copies - 1
        if fault:
            self.counts[fault] += 1
        if copies > 1:
            self.counts["blank" if fault == "blank" else "duplicate"] += copies - 1
        while (name := EDITS[best >> 2 * self.state & 3]) == "I":
            yield self.insert()
        extra = BROKEN * (fault == "truncated")
        if name == "D":
            yield self.edit("D", DELETE, turn=turn)
        elif name == "R":
            role, self.state = GIVES[self.state], NEXT[self.state]
            yield self.edit("R", REROLE + extra, role, text, turn)
        else:
            self.state = after_keep(self.state, CLASSES[role[0]])
            yield self.edit("K", KEEP + extra, role, text, turn)
        if copies > 1:
            yield self.edit("D", DELETE, turn=turn, times=copies - 1)

    def end(self) -> Iterator[tuple]:
        while self.state not in ENDS:
            yield self.insert()

    def report(self) -> tuple:
        gaps = self.high - self.low + 1 - self.turns if self.turns else 0
        return (self.conv, gaps, *self.counts.values(), self.illegal, self.cost, "".join(self.audit), self.digest.hexdigest())


def repair(rows: DataFrame, result: str = "turns", conv_col: str = "conv_id", turn_col: str = "turn",
           role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The repaired conversations.

    ``turns``: one row per edit: conv_id, at (place in the repaired conversation; null if deleted), turn (null if
    inserted), edit, role, text; further copies of a row that is deleted as often share one row.
    ``report``: one row per conversation: gaps, faults, cost, initials of the edits, digest of ``role:text`` lines.
    """
    names = (conv_col, turn_col, role_col, text_col)
    marked = stage(backwards(with_faults(rows, names)), "back-pointers")
    kinds = {"kind": rows.schema[conv_col].dataType.simpleString(), "turn": rows.schema[turn_col].dataType.simpleString()}
    schema = (REPORT if result == "report" else TURNS).format(**kinds)
    fields = [f.strip().split(" ", 1)[0] for f in schema.split(", ")]

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk = None
        for batch in batches:
            edits, reports = [], []

            def finish() -> None:
                edits.extend(walk.end())
                reports.append(walk.report())

            for conv, *row in zip(*(batch.column(c).to_pylist() for c in ("conv", *ORDER, "copies", "fault", "best"))):
                if walk is None or walk.conv != conv:
                    if walk is not None:
                        finish()
                    walk = Walk(conv)
                made = walk.row(*row)
                if result == "report":
                    for _ in made:
                        pass
                else:
                    edits.extend(made)
            yield as_batch(reports if result == "report" else edits, batch)
        if walk is not None:
            edits = list(walk.end())
            yield as_batch([walk.report()] if result == "report" else edits, batch)

    def as_batch(made: list[tuple], batch: pa.RecordBatch) -> pa.RecordBatch:
        if result == "report":
            types = [batch.column("conv").type, *[pa.int64()] * 6, pa.string(), pa.string()]
        else:
            types = [batch.column("conv").type, pa.int64(), batch.column("turn").type, *[pa.string()] * 3]
        columns = list(zip(*made)) or [[]] * len(types)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], fields)

    order = [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    return marked.repartition("conv").sortWithinPartitions(*order).mapInArrow(stream, schema)
