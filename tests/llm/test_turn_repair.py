"""Conversation repair against a search over (cost, audit) pairs, on hard rows and on long conversations."""

import hashlib
import heapq
import random
import zlib
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import functions as F

from palisade.llm import conversation_queries, queries, turn_repair

SCHEMA = "conv_id long, turn long, role string, text string"


def hard_conversations(spark, extra=None):
    long = []
    rng = random.Random(3)
    for t in range(260):
        long.append((7, t, rng.choice(["user", "assistant", "system", "tool", None, ""]), rng.choice(["Fine.", "cut", "  ", "a? ", None, f"own {t}.", f"own {t}"])))
    rows = long + [
        (1, 0, "system", "Be kind."), (1, 1, "user", "Hello there."), (1, 2, "assistant", "Hi."), (1, 9, "user", "Bye"),
        (2, None, "user", "No turn."), (2, None, None, None), (2, 3, "assistant", "x" * 70_000 + "."), (2, 3, "assistant", "tie."), (2, 3, "assistant", "tie."),
        (3, 5, None, None), (4, 1, "s", "Only a system turn."), (5, -3, "assistant", " ! "), (5, -2, "USER", "Question?\n\t"),
        (None, 1, "user", "Nobody's."), (None, 2, "assistant", "Nobody's answer"), (-5, 1, "user", "日本。"), (-5, 2, "assistant", "🙂!"),
    ]
    df = spark.createDataFrame(rows + rows[-4:], SCHEMA)
    for name in (extra or "").split(","):
        df = df.selectExpr("*", f"'{name}' AS {name}") if name else df
    return df


def cheapest(turns):
    """(cost, audit) by Dijkstra's search, where turns are (initial, fault)."""
    step = {"": "u", "s": "u", "u": "a", "a": "u"}
    heap, done = [(0, "", 0, "")], set()
    while heap:
        cost, audit, i, last = heapq.heappop(heap)
        if (i, last) in done:
            continue
        done.add((i, last))
        if i == len(turns) and last in ("", "a"):
            return cost, audit
        heapq.heappush(heap, (cost + 3, audit + "I", i, step[last]))
        if i < len(turns):
            initial, fault = turns[i]
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, last))
            if fault not in ("blank", "duplicate"):
                more = 3 if fault == "truncated" else 0
                heapq.heappush(heap, (cost + 3 + more, audit + "R", i + 1, step[last]))
                if initial == step[last] or (initial == "s" and last == ""):
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, initial))


def by_hand(rows):
    """The query's result from all rows of a table, by its contract."""
    after, ids = defaultdict(list), {r[0] for r in rows}
    for c, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        h = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if h == 1 else text.translate(str.maketrans("", "", ".!?")) if h == 2 else text
        role = "user" if h == 4 else role
        after[c] += [(turn, role, text)] * {0: 0, 3: 2}.get(h, 1)
    out = {}
    for c in ids:
        turns = sorted(after[c], key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        faults, seen = [], set()
        for _, role, text in turns:
            visible = text.rstrip(" \t\n\x0b\f\r")
            faults.append("blank" if not visible else "duplicate" if (role, text) in seen else "truncated" if visible[-1] not in ".!?" else None)
            seen.add((role, text))
        cost, audit = cheapest([(r[1][:1], f) for r, f in zip(turns, faults, strict=True)])
        lines, i, last = [], 0, ""
        for e in audit:
            new = {"": "user", "s": "user", "u": "assistant", "a": "user"}[last]
            role, text = (new, "") if e == "I" else (turns[i][1] if e == "K" else new, turns[i][2])
            i += e != "I"
            if e != "D":
                lines.append(f"{role}:{text}")
                last = role[:1]
        known = [t for t, _, _ in turns if t is not None]
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(turns, turns[1:])]
        out[c] = (max(known) - min(known) + 1 - len(set(known)) if known else 0, *(faults.count(k) for k in ("blank", "duplicate", "truncated")),
                  sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def as_result(rows):
    return {r["conv_id"]: (*(r[c] for c in conversation_queries.COUNTS[:5]), r["cost"], r["audit"], r["repaired_sha256"]) for r in rows}


def test_query_on_hard_rows(spark, tmp_path):
    spark.conf.set("spark.sql.caseSensitive", "true")  # only to write and read two spellings of one name
    try:
        df = hard_conversations(spark, "TEXT,audit,plan,seen")
        df.repartition(5).write.parquet(f"{tmp_path}/conversations.parquet")
        rows = queries.SPARK["op12_turn_repair"](spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.caseSensitive")
    want = by_hand([tuple(r) for r in hard_conversations(spark).collect()])
    assert as_result(rows) == want and len(rows) == len(want)


def test_query_on_a_table(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.1/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert as_result(queries.SPARK["op12_turn_repair"](spark, "/root/testdata/sf0.1").collect()) == by_hand(rows)


def test_weights_of_short_and_very_long_conversations():
    rng = random.Random(9)
    for n in [*range(8), 63, 64, 65, 128, 500] + [rng.randrange(1, 12) for _ in range(300)]:
        turns = [(rng.choice("suuuaaax"), rng.choice([None, None, None, "truncated", "blank", "duplicate"])) for _ in range(n)]
        rows = [(1, None, a, "", f, a) for a, f in turns][::-1]
        kinds = [pa.int64(), pa.int64(), *[pa.string()] * 4]
        names = ["conv_id", "turn", "role", "text", "fault", "initial"]
        batches = [pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows[i:i + 7]), kinds)], names=names) for i in range(0, n, 7)]
        planned = [r for b in turn_repair._plan(iter(batches)) for r in b.to_pylist()][::-1]
        kinds = [pa.int64(), pa.int64(), *[pa.string()] * 4, pa.int64()]
        again = [pa.RecordBatch.from_pylist(planned[i:i + 5]) for i in range(0, n, 5)]
        again = [b.cast(pa.schema(list(zip(b.schema.names, kinds, strict=True)))) for b in again]
        edits = [r for b in turn_repair._edit(iter(again)) for r in b.to_pylist()]
        assert "".join(r["edit"] for r in edits) == cheapest(turns)[1], turns


def test_repairs_are_rows_and_read_by_one_shuffle(spark):
    df = hard_conversations(spark)
    edits = turn_repair.repair_conversations(df)
    assert edits.columns == ["conv_id", "step", "edit", "fault", "turn", "old_role", "role", "text"]
    assert edits._jdf.queryExecution().executedPlan().toString().count("Exchange") <= 2  # the shuffle, and its name in the adaptive plan
    kept = edits.where("edit <> 'D' AND conv_id = 1").orderBy("step").collect()
    assert [(r["role"], r["text"]) for r in kept] == [("system", "Be kind."), ("user", "Hello there."), ("assistant", "Hi.")]
    assert turn_repair.repair_conversations(df.limit(0)).count() == 0
    assert edits.where(F.col("conv_id").isNull()).count() == 4


def test_no_conversations(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    assert queries.SPARK["op12_turn_repair"](spark, str(tmp_path)).count() == 0
