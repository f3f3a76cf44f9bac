"""The prefix tree against a plain one, and places in groups that span many partitions."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from palisade.llm import prefix_trie, queries
from palisade.llm.ordering import MASK, in_order
from tests.llm.test_turn_repair import SCHEMA, hard_conversations

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def rebuilt_by_hand(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [r[2:] for r in sorted(turns)] for c, turns in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        giver = c - (c % 5 if c >= 0 else -(-c % 5))
        out[c] = own.get(giver, [])[:h] + turns[h:]
    return out


def plain_trie(convs):
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    kids = defaultdict(list)
    for node in members:
        if node:
            kids[node[:-1]].append(node)
    below = {}
    for node in sorted(members, key=len, reverse=True):
        saved = (len(members[node]) - 1) * len(node[-1][1].encode()) if node else 0
        below[node] = (sum(below[k][0] for k in kids[node]) or 1, saved + sum(below[k][1] for k in kids[node]))
    return sorted((min(members[n]), len(n), min(members[n[:-1]]) if n else None, len(members[n]), len(kids[n]), *below[n],
                   hashlib.sha256(",".join(map(str, sorted(ends[n]))).encode()).hexdigest()) for n in members)


def result(df):
    return sorted(tuple(r[c] for c in COLUMNS) for r in df.collect())


def write(df, path):
    df.repartition(4).write.parquet(f"{path}/conversations.parquet")
    return str(path)


def test_query_on_hard_rows(spark, tmp_path):
    df = hard_conversations(spark, "depth,p1,at,n_bytes")
    rows = [tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()]
    assert result(queries.SPARK["op11_prefix_trie"](spark, write(df, tmp_path))) == plain_trie(rebuilt_by_hand(rows))


def test_query_on_copies_and_long_conversations(spark, tmp_path):
    rng = random.Random(4)
    rows = []
    for c in range(0, 400, 2):  # few texts, so that conversations share, fork and end everywhere
        for t in range(rng.randrange(1, 14)):
            rows.append((c, t, rng.choice(["user", "user", "assistant"]), rng.choice(["a", "a", "a", "é", None])))
    rows += [(c, t, "user", f"hot {t}") for c in range(1001, 1300, 5) for t in range(11)]
    rows += [(5, t, "user", f"long {t % 7}") for t in range(3000)] + [(10, t, "user", f"long {t % 7}") for t in range(2500)] + [(-7, 0, "user", "below zero")]
    df = spark.createDataFrame(rows, SCHEMA)
    assert result(queries.SPARK["op11_prefix_trie"](spark, write(df, tmp_path))) == plain_trie(rebuilt_by_hand(rows))


def test_trie_is_made_of_any_turns(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "yes"), (2, 0, "user", "hi"), (9, None, "user", "hi")]
    turns = prefix_trie.turns_of(spark.createDataFrame(rows, SCHEMA))
    trie = prefix_trie.build_trie(turns, spark.createDataFrame([(1,), (2,), (9,), (20,)], "conv_id long"))
    assert [tuple(r) for r in trie.nodes.orderBy("depth").select(*COLUMNS[:-1]).collect()] == [(1, 0, None, 4, 1, 1, 4), (1, 1, 1, 3, 1, 1, 4), (1, 2, 1, 1, 0, 1, 0)]
    assert {r["conv_id"]: r["depth"] for r in trie.ends.collect()} == {1: 2, 2: 1, 9: 1, 20: 0}


def test_no_conversations(spark, tmp_path):
    assert queries.SPARK["op11_prefix_trie"](spark, write(spark.createDataFrame([], SCHEMA), tmp_path)).count() == 0


@pytest.mark.parametrize("groups", [[5], [1, 900, 2, 1], [300, 300, 300], []])
def test_places_in_groups_over_partitions(spark, groups):
    rng = random.Random(len(groups))
    rows = [(g, i, rng.randrange(MASK)) for g, n in enumerate(groups) for i in range(n)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g long, i long, v long").repartition(3)
    got = in_order(df, "g", [F.col("i")], ["g", "i", "v"], ["v"]).collect()
    total = defaultdict(int)
    for r in sorted(got):
        total[r["g"]] += r["v"]
        assert r["at"] == r["i"] and r["v_upto"] == total[r["g"]] & MASK
    assert len(got) == len(rows)
