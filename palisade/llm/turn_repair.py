"""Cheapest repair of conversations into an optional system turn and alternating user and assistant turns.

Each conversation is a path through a graph: a node is a place between turns and what the roles so far allow next (nothing yet, a
system turn, a user turn, an assistant turn); an edge keeps, re-roles, deletes or inserts a turn. An edge's weight is one whole number:
its cost in the high digits, and the letter of the edit in the digit that its place in the audit has, low places for late letters and
zeros after the end. The smallest sum is then the cheapest repair and, of equals, the one whose audit comes first by letters. Ordinary
integer minima decide; nothing else compares.

Letters of more than ``CHUNK`` turns to come are replaced by the rank of the four nodes' remainders, which is one digit, so numbers stay
short however long a conversation is.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from palisade.llm.tables import only, small_batches

SPACES = " \t\n\x0b\f\r"
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: letters as digits, in the order of the letters; 0 is the padding
LETTERS = "\0DIKR"
BITS = 3
CHUNK = 64
#: at most two insertions stand before a turn, and one digit holds the rank of what comes later
DIGITS = 3 * CHUNK + 3
LOW = BITS * DIGITS
MASK = (1 << LOW) - 1
# nodes
START, SYSTEM, USER, ASSISTANT = range(4)
#: where an inserted or re-roled turn leads: a user turn, or after a user turn an assistant turn
NEXT = (USER, USER, ASSISTANT, USER)
ROLE = {USER: "user", ASSISTANT: "assistant"}
KEPT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}

ROWS = "conv_id long, step long, edit string, fault string, turn long, old_role string, role string, text string"


def _put(value: int, cost: int, letters: str) -> int:
    """The weight of a path that begins with these letters at this cost and goes on as ``value``: its letters move to later places."""
    for letter in reversed(letters):
        value = (value & ~MASK) | (LETTERS.index(letter) << (LOW - BITS)) | ((value & MASK) >> BITS)
    return value + (cost << LOW)


def _ending() -> list[int]:
    """Weights after the last turn: a user turn still needs its answer, a lone system turn a whole exchange."""
    return [0, _put(0, 2 * INSERT, "II"), _put(0, INSERT, "I"), 0]


def _before(after: list[int], initial: str, fault: str | None) -> tuple[list[int], str]:
    """Weights of the four nodes before a turn, and for each how to go on: twice-three choices as a letter (insertions, edit)."""
    extra = TRUNCATED if fault == "truncated" else 0
    edits: list[tuple[int, int]] = []
    for node in range(4):
        ways = [(_put(after[node], DELETE, "D"), 0)]
        if fault not in ("blank", "duplicate"):
            if (node, initial) in KEPT:
                ways.append((_put(after[KEPT[node, initial]], KEEP + extra, "K"), 1))
            ways.append((_put(after[NEXT[node]], REROLE + extra, "R"), 2))
        edits.append(min(ways))
    weights, plan = [], ""
    for node in range(4):
        ways, at = [], node
        for n in range(3):
            ways.append((_put(edits[at][0], n * INSERT, "I" * n), 3 * n + edits[at][1]))
            at = NEXT[at]
        weight, way = min(ways)
        weights.append(weight)
        plan += chr(97 + way)
    return weights, plan


def _ranked(weights: list[int]) -> list[int]:
    """The same costs, with letters replaced by their rank: equal remainders have equal ranks."""
    order = {low: rank for rank, low in enumerate(sorted({w & MASK for w in weights}))}
    return [(w & ~MASK) | ((order[w & MASK] + 1) << (LOW - BITS)) for w in weights]


def _plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Turns of whole conversations, the last first: how each of the four nodes before a turn goes on, and how many turns follow."""
    conv, weights, rest = object(), [], 0
    for batch in batches:
        plans, rests = [], []
        for c, initial, fault in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "initial", "fault")), strict=True):
            if c != conv:
                conv, weights, rest = c, _ending(), 0
            elif rest % CHUNK == 0:
                weights = _ranked(weights)
            weights, plan = _before(weights, initial, fault)
            plans.append(plan)
            rests.append(rest)
            rest += 1
        names = ["conv_id", "turn", "role", "text", "fault"]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(plans, pa.string()), pa.array(rests, pa.int64())], names=[*names, "plan", "rest"])


def _edit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Turns of whole conversations with their plans, the first first: the chosen edits, one row each."""
    names = ["conv_id", "step", "edit", "fault", "turn", "old_role", "role", "text"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]
    node = step = 0
    begun = False
    for batch in batches:
        out: list[tuple] = []
        for c, turn, role, text, fault, plan, rest in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "turn", "role", "text", "fault", "plan", "rest")), strict=True):
            if not begun:
                node, step, begun = START, 0, True
            inserts, edit = divmod(ord(plan[node]) - 97, 3)
            for _ in range(inserts):
                node = NEXT[node]
                out.append((c, step, "I", None, None, None, ROLE[node], ""))
                step += 1
            if edit == 0:
                out.append((c, step, "D", fault, turn, role, None, text))
            elif edit == 1:
                node = KEPT[node, role[:1]]
                out.append((c, step, "K", fault, turn, role, role, text))
            else:
                node = NEXT[node]
                out.append((c, step, "R", fault, turn, role, ROLE[node], text))
            step += 1
            if rest == 0:
                while node in (SYSTEM, USER):
                    node = NEXT[node]
                    out.append((c, step, "I", None, None, None, ROLE[node], ""))
                    step += 1
                begun = False
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(zip(*out, strict=True), kinds, strict=True)], names=names)


def repair_conversations(turns: DataFrame) -> DataFrame:
    """The edits of every conversation, one row per edit: ``conv_id, step, edit, fault, turn, old_role, role, text``.

    ``turns`` has conv_id, turn, role, text; other columns are not read. Turns stand by turn (null first), then role and text; a null role
    or text is one space. ``fault`` is the first of: blank (no visible character), duplicate (role and text of an earlier turn), truncated
    (the last visible character is not ``.!?``). Keeping costs 0, a new role 3, deleting 4, an inserted empty turn 3; a truncated turn that
    stays 3 more; blank and duplicate turns must go. ``edit`` is K, R, D or I; ``role`` is the role after the edit, null for deleted
    turns, whose text is the old one. Rows without conv_id are one conversation. Repeated rows are duplicates. An empty table gives none.

    One shuffle, by conversation; what follows sorts and reads each partition as a stream, so neither texts nor turns of a conversation are
    ever gathered. Partitions hold whole conversations, and rows in the order of steps, for what reads them next without a shuffle.
    """
    small_batches(turns.sparkSession)
    rows = only(turns, "conv_id", "turn", "role", "text").select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    seen = F.row_number().over(Window.partitionBy("conv_id", "role", "text").orderBy(F.col("turn").asc_nulls_first()))
    rows = rows.repartition("conv_id").withColumn("seen", seen)
    visible = F.rtrim(F.col("text"), F.lit(SPACES))
    fault = F.when(visible == "", "blank").when(F.col("seen") > 1, "duplicate").when(~F.right(visible, F.lit(1)).isin(".", "!", "?"), "truncated")
    rows = rows.select("*", F.substring("role", 1, 1).alias("initial"), fault.alias("fault"))
    rows = rows.sortWithinPartitions(F.col("conv_id").desc(), F.col("turn").desc_nulls_last(), F.col("role").desc(), F.col("text").desc(), F.col("seen").desc())
    planned = rows.mapInArrow(_plan, "conv_id long, turn long, role string, text string, fault string, plan string, rest long")
    return planned.sortWithinPartitions("conv_id", F.col("rest").desc()).mapInArrow(_edit, ROWS)
