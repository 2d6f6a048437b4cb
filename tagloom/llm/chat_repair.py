"""Repair of the turn structure of conversations by a square-root checkpointed dynamic programme.

A repaired conversation is empty or has an optional system turn and then user and assistant turns in alternation. The
state before a row says what was last written; the least cost from a row to the end, for each state, is a vector of
four numbers, computed backwards. Only the vectors at checkpoints are stored. Walking forward from the start, the
vectors of one block are computed again from the checkpoint behind it, and of all edits that lose nothing (tight ones)
the first by its letter is taken, so that the edits are the ASCII-least of the cheapest.

Rows are sorted over the whole table by conversation and turn, so a conversation with a third of all rows lies in many
tasks, in segments. Of each segment, the cost from each state at its begin to each state at its end is a 4 x 4
matrix; small rows alone then give the vector behind every segment and the state at its begin. Inside a segment the
square root of its rows is the distance of checkpoints.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.llm.common import settle

#: Rows and bytes of text that a segment holds; a longer single row is one segment.
SEGMENT_ROWS, SEGMENT_BYTES = 4096, 4_000_000
DELETE, ROLE, INSERT, CUT = 4, 3, 3, 3
#: States by what was last written: nothing, a system turn, a user turn, an assistant turn.
START, SYSTEM, USER, ASSISTANT = range(4)
_FAR = 1 << 60
Vector = tuple[int, int, int, int]
#: A row as the programme sees it: initial of the role, whether it must go, cost if it stays.
Step = tuple[str, bool, int]
#: State that a written turn leads to, for each state before it; none: not allowed.
_AFTER = {
    "s": (SYSTEM, None, None, None), "u": (USER, USER, None, USER), "a": (None, None, ASSISTANT, None),
}
#: The role that may follow a state besides a leading system turn.
_NEXT = ("u", "u", "a", "u")
_NAME = {"u": "user", "a": "assistant"}


def with_inserts(v: list[int] | Vector) -> Vector:
    """Costs where turns may be inserted before anything else is done."""
    user = min(v[USER], INSERT + v[ASSISTANT])
    return min(v[START], INSERT + user), min(v[SYSTEM], INSERT + user), user, min(v[ASSISTANT], INSERT + user)


def back(step: Step, v: Vector) -> Vector:
    """Costs before a row from those behind it."""
    initial, must_go, extra = step
    best = [DELETE + x for x in v]
    if not must_go:
        after = _AFTER.get(initial)
        for state in range(4):
            best[state] = min(best[state], ROLE + extra + v[_AFTER[_NEXT[state]][state]])
            if after and after[state] is not None:
                best[state] = min(best[state], extra + v[after[state]])
    return with_inserts(best)


#: Costs at the end of a conversation.
END: Vector = with_inserts([0, _FAR, _FAR, 0])


def matrix(steps: list[Step]) -> list[int]:
    """Least cost from each state before the rows to each state behind them, row after row."""
    columns = []
    for state in range(4):
        v: Vector = tuple(0 if s == state else _FAR for s in range(4))
        for step in reversed(steps):
            v = back(step, v)
        columns.append(v)
    return [columns[j][i] for i in range(4) for j in range(4)]


def through(costs: list[int], v: Vector) -> Vector:
    """Costs before a segment from its matrix and those behind it."""
    return tuple(min(costs[4 * i + j] + v[j] for j in range(4)) for i in range(4))


def walk(steps: list[Step], end: Vector, state: int, last: bool) -> tuple[str, int]:
    """The ASCII-least of the cheapest edits of the rows from a state, and the state behind them; `last`: then the conversation ends."""
    n = len(steps)
    size = max(1, math.isqrt(n))
    stored = {n: end}
    v = end
    for i in range(n - 1, -1, -1):
        v = back(steps[i], v)
        if i % size == 0:
            stored[i] = v
    edits: list[str] = []

    def insert(here: Vector) -> bool:
        nonlocal state
        to = _AFTER[_NEXT[state]][state]
        if INSERT + here[to] != here[state]:
            return False
        edits.append("I")
        state = to
        return True

    for low in range(0, n, size):
        high = min(n, low + size)
        block = [stored[high]]
        for i in range(high - 1, low - 1, -1):
            block.append(back(steps[i], block[-1]))
        block.reverse()
        for i in range(low, high):
            initial, must_go, extra = steps[i]
            here, behind = block[i - low], block[i - low + 1]
            while True:
                if DELETE + behind[state] == here[state]:
                    edits.append("D")
                elif insert(here):
                    continue
                elif not must_go and _AFTER.get(initial, (None,) * 4)[state] is not None and extra + behind[_AFTER[initial][state]] == here[state]:
                    edits.append("K")
                    state = _AFTER[initial][state]
                else:
                    edits.append("R")
                    state = _AFTER[_NEXT[state]][state]
                break
    while last and state not in (START, ASSISTANT):
        insert(end)
    return "".join(edits), state


def written(edits: str, state: int, roles: list[str], texts: list[str]) -> list[str]:
    """`role:text` of the turns that the edits leave."""
    out: list[str] = []
    i = 0
    for edit in edits:
        if edit == "I" or edit == "R":
            role = _NEXT[state]
            out.append(f"{_NAME[role]}:{texts[i] if edit == 'R' else ''}")
            state = _AFTER[role][state]
        elif edit == "K":
            out.append(f"{roles[i]}:{texts[i]}")
            state = _AFTER[roles[i][0]][state]
        i += edit != "I"
    return out


def cost_of(edits: str, steps: list[Step]) -> int:
    i = total = 0
    for edit in edits:
        total += {"I": INSERT, "D": DELETE, "K": 0, "R": ROLE}[edit] + (steps[i][2] if edit in "KR" else 0)
        i += edit != "I"
    return total


def _steps(roles: list[str], faults: list[str]) -> list[Step]:
    return [(r[:1], f in ("blank", "duplicate"), CUT if f == "truncated" else 0) for r, f in zip(roles, faults)]


_SEGMENT = "key string, segment bigint, roles array<string>, texts array<string>, faults array<string>"


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (key, role, text, fault, copies) as segments, numbered in the order of the sorted table."""
    task = TaskContext.get()
    number = (task.partitionId() if task else 0) << 40
    key, size, held = None, 0, ([], [], [])
    schema = pa.schema([("key", pa.string()), ("segment", pa.int64()), *((n, pa.list_(pa.string())) for n in ("roles", "texts", "faults"))])

    def flush() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"key": [key], "segment": [number], "roles": [held[0]], "texts": [held[1]], "faults": [held[2]]}, schema)

    waiting: list[pa.RecordBatch] = []
    for batch in batches:
        for k, role, text, fault, copies in zip(*(c.to_pylist() for c in batch.columns)):
            for _ in range(copies):
                if held[0] and (k != key or len(held[0]) >= SEGMENT_ROWS or size + len(text) > SEGMENT_BYTES):
                    waiting.append(flush())
                    number, held, size = number + 1, ([], [], []), 0
                key = k
                for x, new in zip(held, (role, text, fault)):
                    x.append(new)
                size += len(text)
                fault = fault if fault == "blank" else "duplicate"
                if len(waiting) >= 1000 or waiting and size + len(text) > SEGMENT_BYTES:
                    yield from _joined(waiting, schema)
                    waiting = []
        yield from _joined(waiting, schema)
        waiting = []
    if held[0]:
        yield flush()


def _joined(batches: list[pa.RecordBatch], schema: pa.Schema) -> list[pa.RecordBatch]:
    return pa.Table.from_batches(batches, schema).combine_chunks().to_batches() if batches else []


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        costs = [matrix(_steps(r, f)) for r, f in zip(batch["roles"].to_pylist(), batch["faults"].to_pylist())]
        yield pa.RecordBatch.from_arrays([batch["key"], batch["segment"], pa.array(costs, pa.list_(pa.int64()))], names=["key", "segment", "costs"])


def _behind(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of segments sorted from the last to the first: the vector behind each, and whether it is the last."""
    key, v, started = None, END, False
    for batch in batches:
        ends, last = [], []
        for k, costs in zip(batch["key"].to_pylist(), batch["costs"].to_pylist()):
            last.append(not started or k != key)
            if last[-1]:
                key, v, started = k, END, True
            ends.append(list(v))
            v = through(costs, v)
        yield pa.RecordBatch.from_arrays([batch["key"], batch["segment"], pa.array(ends, pa.list_(pa.int64())), pa.array(last)], names=["key", "segment", "end", "last"])


def _exits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The state behind a segment for each state at its begin."""
    for batch in batches:
        exits = []
        for roles, faults, end, last in zip(*(batch[c].to_pylist() for c in ("roles", "faults", "end", "last"))):
            steps = _steps(roles, faults)
            exits.append([walk(steps, tuple(end), s, last)[1] for s in range(4)])
        yield pa.RecordBatch.from_arrays([batch["key"], batch["segment"], pa.array(exits, pa.list_(pa.int64()))], names=["key", "segment", "exits"])


def _begins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of segments sorted from the first to the last: the state at the begin of each."""
    key, state, started = None, START, False
    for batch in batches:
        begins = []
        for k, exits in zip(batch["key"].to_pylist(), batch["exits"].to_pylist()):
            if not started or k != key:
                key, state, started = k, START, True
            begins.append(state)
            state = exits[state]
        yield pa.RecordBatch.from_arrays([batch["key"], batch["segment"], pa.array(begins, pa.int64())], names=["key", "segment", "begin"])


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: dict[str, list] = {"edits": [], "cost": [], "turns": [], "blank": [], "duplicate": [], "truncated": [], "illegal": [], "first": [], "final": []}
        for roles, texts, faults, end, last, begin in zip(*(batch[c].to_pylist() for c in ("roles", "texts", "faults", "end", "last", "begin"))):
            steps = _steps(roles, faults)
            edits, _ = walk(steps, tuple(end), begin, last)
            out["edits"].append(edits)
            out["cost"].append(cost_of(edits, steps))
            out["turns"].append(written(edits, begin, roles, texts))
            for fault in ("blank", "duplicate", "truncated"):
                out[fault].append(faults.count(fault))
            out["illegal"].append(sum((a[:1] + b[:1]) not in ("su", "ua", "au") for a, b in zip(roles, roles[1:])))
            out["first"].append(roles[0][:1])
            out["final"].append(roles[-1][:1])
        strings = {"edits": pa.string(), "turns": pa.list_(pa.string()), "first": pa.string(), "final": pa.string()}
        yield pa.RecordBatch.from_arrays([batch["key"], batch["segment"], *(pa.array(v, strings.get(n, pa.int64())) for n, v in out.items())], names=["key", "segment", *out])


_REPAIRED = "key string, segment bigint, edits string, cost bigint, turns array<string>, blank bigint, duplicate bigint, truncated bigint, illegal bigint, first string, final string"


def key_of(column: str) -> Column:
    """A conversation id as text, null among them."""
    return F.coalesce(F.concat(F.lit("="), F.col(column).cast("string")), F.lit(""))


def repair(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Segments of the repaired conversations, in the order of `segment`: key, segment, edits, cost, turns (`role:text`),
    the rows' faults (blank, duplicate, truncated), illegal (neighbours within the segment), first and final (initials).

    Rows of a conversation stand by turn, a null one first, then by role and text. Edits: K keeps a row, R sets its
    role to user or assistant (3), D deletes it (4; blank and repeated rows must go), I inserts an empty turn (3); a row
    without an end mark that stays costs 3 more. Null roles and texts are one space. The rows without an id are one
    conversation, of key ''; other keys are `=` and the id. Repeated rows are duplicates; an empty table has no rows.
    Other columns are ignored, so their names cannot clash.
    """
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = turns.select(key_of(conv_col).alias("key"), F.col(turn_col).alias("turn"), filled(role_col).alias("role"), filled(text_col).alias("text"))
    rows = rows.groupBy("key", "turn", "role", "text").agg(F.count("*").alias("copies"))
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    cut = ~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    rows = rows.withColumn("print", F.when(~blank, F.sha2(F.concat("role", F.lit("\x00"), "text"), 256)))
    earliest = rows.where("print IS NOT NULL").groupBy("key", "print").agg(F.min(F.struct("turn")).alias("earliest"), F.count("*").alias("n")).where("n > 1").drop("n")
    rows = rows.join(earliest, ["key", "print"], "left")
    fault = F.when(blank, "blank").when(F.struct("turn") > F.col("earliest"), "duplicate").when(cut, "truncated").otherwise("")
    rows = rows.select("key", "turn", "role", "text", fault.alias("fault"), "copies")
    # the sort deals by the whole order, so the rows of one conversation can lie in many tasks
    rows = rows.repartitionByRange("key", "turn", "role", "text").sortWithinPartitions("key", "turn", "role", "text")
    segments = settle(rows.drop("turn").mapInArrow(_segments, _SEGMENT), "segments")

    several = segments.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    long = segments.join(several, "key", "left_semi")
    costs = settle(long.mapInArrow(_matrices, "key string, segment bigint, costs array<bigint>"), "matrices")
    ends = costs.repartition("key").sortWithinPartitions("key", F.desc("segment")).mapInArrow(_behind, "key string, segment bigint, end array<bigint>, last boolean")
    ends = settle(ends, "checkpoints")
    exits = long.join(ends, ["key", "segment"]).mapInArrow(_exits, "key string, segment bigint, exits array<bigint>")
    begins = exits.repartition("key").sortWithinPartitions("key", "segment").mapInArrow(_begins, "key string, segment bigint, begin bigint")
    known = settle(ends.join(begins, ["key", "segment"]), "states")
    whole = F.array(*(F.lit(x).cast("bigint") for x in END))
    ready = segments.join(known, ["key", "segment"], "left").select(
        "key", "segment", "roles", "texts", "faults", F.coalesce("end", whole).alias("end"), F.coalesce("last", F.lit(True)).alias("last"),
        F.coalesce("begin", F.lit(START).cast("bigint")).alias("begin"),
    )
    return ready.mapInArrow(_repaired, _REPAIRED)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted segments as one row per conversation; turns go into the hash and are not kept."""
    names = ("blank", "duplicate", "truncated", "illegal", "cost")
    schema = pa.schema([("key", pa.string()), *((n, pa.int64()) for n in names), ("audit", pa.string()), ("repaired_sha256", pa.string())])
    key, total, audit, digest, final, begun = None, {}, [], None, "", False

    def row() -> dict:
        return {"key": key, **total, "audit": "".join(audit), "repaired_sha256": digest.hexdigest()}

    for batch in batches:
        out = []
        for found in batch.to_pylist():
            if digest is None or found["key"] != key:
                if digest is not None:
                    out.append(row())
                key, total, audit, digest, begun = found["key"], dict.fromkeys(names, 0), [], hashlib.sha256(), False
            elif final + found["first"] not in ("su", "ua", "au"):
                total["illegal"] += 1
            final = found["final"]
            audit.append(found["edits"])
            for name in names:
                total[name] += found[name]
            for turn in found["turns"]:
                digest.update((("\n" if begun else "") + turn).encode("utf-8", "surrogatepass"))
                begun = True
        yield pa.RecordBatch.from_pylist(out, schema)
    if digest is not None:
        yield pa.RecordBatch.from_pylist([row()], schema)


def repair_digests(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation that has rows: key, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    A hash has no parts: the segments of one conversation pass one task, one after another, and only its audit is held.
    """
    found = repair(turns, conv_col, turn_col, role_col, text_col)
    schema = "key string, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"
    found = found.repartition("key").sortWithinPartitions("key", "segment").mapInArrow(_digests, schema)
    gaps = turns.groupBy(key_of(conv_col).alias("key")).agg(
        F.coalesce(F.max(turn_col) - F.min(turn_col) + 1 - F.count_distinct(F.col(turn_col)), F.lit(0)).cast("bigint").alias("gaps")
    )
    return found.join(gaps, "key")
