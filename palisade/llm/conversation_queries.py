"""The queries over conversations, with their SQL."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.llm import prefix_trie, turn_repair
from palisade.llm.registry import query
from palisade.llm.tables import materialise, only, table

#: crc32 of short ASCII texts ``s`` of a table ``{texts}``, as ``crc(s, h)``: the table of the polynomial, then one step per character
CRC_SQL = """
bits AS (
    SELECT n, CAST(n AS BIGINT) AS c, 0 AS k FROM range(256) t(n)
    UNION ALL SELECT n, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
lut AS (SELECT list(c ORDER BY n) AS l FROM bits WHERE k = 8),
steps AS (
    SELECT s, CAST(4294967295 AS BIGINT) AS c, 0 AS i FROM {texts}
    UNION ALL SELECT s, xor(c >> 8, l[1 + xor(c & 255, CAST(ascii(substr(s, i + 1, 1)) AS BIGINT))]), i + 1 FROM steps, lut WHERE i < length(s)),
crc AS (SELECT s, xor(c, 4294967295) AS h FROM steps WHERE i = length(s))"""


def damaged(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` after damage by crc32 of ``conv_id:turn`` modulo 20; a null is one space."""
    rows = only(conversations, "conv_id", "turn", "role", "text").select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), *[F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")])
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    rows = rows.withColumn("damage", F.crc32(key.cast("binary")) % 20).where("damage <> 0")
    text = F.when(F.col("damage") == 1, "").when(F.col("damage") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("damage") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("damage") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
COST = {"K": turn_repair.KEEP, "R": turn_repair.REROLE, "D": turn_repair.DELETE, "I": turn_repair.INSERT}


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per conversation from its edits in order; only the audit grows with a conversation."""
    conv: object = None
    n: dict[str, int] = {}
    audit: list[str] = []
    begun = False

    def close():
        n["gaps"] = n["last"] - n["first"] + 1 - n["turns"] if n["turns"] else 0
        return (conv, *(n[c] for c in COUNTS), "".join(audit), digest.hexdigest())

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64()] * (1 + len(COUNTS)) + [pa.string()] * 2
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)],
                                          names=["conv_id", *COUNTS, "audit", "repaired_sha256"])

    for batch in batches:
        out = []
        for c, step, edit, fault, turn, old, role, text in zip(*(batch.column(k).to_pylist() for k in range(8)), strict=True):
            if step == 0:
                if begun:
                    out.append(close())
                conv, begun, audit, digest = c, True, [], hashlib.sha256()
                n = dict.fromkeys([*COUNTS, "turns"], 0) | {"first": None, "last": None}
                before, lines = None, 0
            audit.append(edit)
            n["cost"] += COST[edit] + (turn_repair.TRUNCATED if fault == "truncated" and edit != "D" else 0)
            if edit != "I":
                if fault:
                    n[fault] += 1
                initial = old[:1]
                n["illegal"] += before is not None and before + initial not in ("su", "ua", "au")
                before = initial
                if turn is not None and turn != n["last"]:
                    n["first"] = turn if n["turns"] == 0 else n["first"]
                    n["last"], n["turns"] = turn, n["turns"] + 1
            if edit != "D":
                digest.update((("\n" if lines else "") + f"{role}:{text}").encode())
                lines += 1
        if out:
            yield batch_of(out)
    if begun:
        yield batch_of([close()])


def _put(v: str, cost: str, letters: str) -> str:
    """SQL: a weight as text, nine digits of cost and the audit; these letters before it."""
    return f"lpad(CAST(CAST(substr({v}, 1, 9) AS BIGINT) + {cost} AS VARCHAR), 9, '0') || '{letters}' || substr({v}, 10)"


def _best(node: str, kept: dict[str, str], follows: str) -> str:
    """SQL: the least weight of an edit of one turn at a node."""
    keep = "".join(f" WHEN initial = '{i}' THEN {_put(to, 't', 'K')}" for i, to in kept.items())
    return f"least(CASE WHEN must THEN NULL{keep} END, CASE WHEN NOT must THEN {_put(follows, '3 + t', 'R')} END, {_put(node, '4', 'D')})"


REPAIR_SQL = f"""
WITH RECURSIVE src AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
           coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS s FROM conversations),
texts AS (SELECT DISTINCT s FROM src),
{CRC_SQL.format(texts='texts')},
hurt AS (
    SELECT conv_id, turn, CASE WHEN h % 20 = 4 THEN 'user' ELSE role END AS role,
           CASE h % 20 WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
           unnest(CASE WHEN h % 20 = 3 THEN [1, 2] ELSE [1] END) AS copy
    FROM src JOIN crc USING (s) WHERE h % 20 <> 0),
placed AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i, count(*) OVER (PARTITION BY conv_id) AS n,
           row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS seen,
           regexp_replace(text, '[\\x20\\x09-\\x0D]+$', '') AS visible, left(role, 1) AS initial FROM hurt),
rows AS (
    SELECT *, CASE WHEN visible = '' THEN 'blank' WHEN seen > 1 THEN 'duplicate' WHEN right(visible, 1) NOT IN ('.', '!', '?') THEN 'truncated' END AS fault,
           lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial AS pair FROM placed),
marked AS (SELECT conv_id, i, initial, coalesce(fault IN ('blank', 'duplicate'), false) AS must, CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END AS t FROM rows),
dp AS (
    SELECT conv_id, n AS i, '000000000' AS v0, '000000006II' AS vs, '000000003I' AS vu, '000000000' AS va FROM rows WHERE i = n
    UNION ALL
    SELECT conv_id, i - 1, least(e0, {_put('eu', '3', 'I')}, {_put('ea', '6', 'II')}), least(es, {_put('eu', '3', 'I')}, {_put('ea', '6', 'II')}),
           least(eu, {_put('ea', '3', 'I')}, {_put('eu', '6', 'II')}), least(ea, {_put('eu', '3', 'I')}, {_put('ea', '6', 'II')})
    FROM (SELECT conv_id, i, {_best('v0', {'s': 'vs', 'u': 'vu'}, 'vu')} AS e0, {_best('vs', {'u': 'vu'}, 'vu')} AS es,
                 {_best('vu', {'a': 'va'}, 'va')} AS eu, {_best('va', {'u': 'vu'}, 'vu')} AS ea
          FROM dp JOIN marked USING (conv_id, i))),
audits AS (SELECT conv_id, CAST(substr(v0, 1, 9) AS BIGINT) AS cost, substr(v0, 10) AS audit FROM dp WHERE i = 0),
edits AS (
    SELECT conv_id, p, audit[p] AS e, length(regexp_replace(audit[1:p], '[I]', '', 'g')) AS i, length(regexp_replace(audit[1:p], '[D]', '', 'g')) AS o
    FROM (SELECT conv_id, audit, unnest(range(1, length(audit) + 1)) AS p FROM audits)),
begins AS (SELECT e.conv_id FROM edits e JOIN rows r USING (conv_id, i) WHERE e.o = 1 AND e.e = 'K' AND r.initial = 's'),
final AS (
    SELECT e.conv_id, e.p, CASE WHEN e.e = 'K' THEN r.role WHEN (e.o - 1 - (b.conv_id IS NOT NULL)::INT) % 2 = 0 THEN 'user' ELSE 'assistant' END AS role,
           CASE WHEN e.e = 'I' THEN '' ELSE r.text END AS text
    FROM edits e LEFT JOIN rows r USING (conv_id, i) LEFT JOIN begins b ON b.conv_id = e.conv_id WHERE e.e <> 'D'),
hashes AS (SELECT conv_id, sha256(string_agg(role || ':' || text, chr(10) ORDER BY p)) AS repaired_sha256 FROM final GROUP BY conv_id),
counts AS (
    SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
           count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
           count(*) FILTER (length(pair) > 0 AND pair NOT IN ('su', 'ua', 'au')) AS illegal FROM rows GROUP BY conv_id)
SELECT d.conv_id, coalesce(c.gaps, 0) AS gaps, coalesce(c.blank, 0) AS blank, coalesce(c.duplicate, 0) AS duplicate, coalesce(c.truncated, 0) AS truncated,
       coalesce(c.illegal, 0) AS illegal, coalesce(a.cost, 0) AS cost, coalesce(a.audit, '') AS audit, coalesce(h.repaired_sha256, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) d LEFT JOIN counts c USING (conv_id) LEFT JOIN audits a USING (conv_id) LEFT JOIN hashes h USING (conv_id)
"""


@query("op12_turn_repair", sql=REPAIR_SQL)
def op12_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    # each partition holds whole conversations with their edits in order, so nothing is shuffled before the digest
    found = turn_repair.repair_conversations(damaged(conversations)).mapInArrow(_digests, f"conv_id long, {', '.join(f'{c} long' for c in COUNTS)}, audit string, repaired_sha256 string")
    every = only(conversations, "conv_id").select(F.col("conv_id").cast("long").alias("id")).distinct()
    joined = every.join(found, F.col("id").eqNullSafe(F.col("conv_id")), "left")
    return joined.select(F.col("id").alias("conv_id"), *[F.coalesce(c, F.lit(0)).alias(c) for c in COUNTS], F.coalesce("audit", F.lit("")).alias("audit"),
                         F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


def rebuilt(turns: DataFrame, ids: DataFrame) -> DataFrame:
    """Turns (as ``turns_of`` gives them) of rebuilt conversations: c takes the first crc32(c) % 9 turns of c - c % 5, then its own beyond as many."""
    given = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9
    whole = F.col("conv_id") % 5 == 0  # its own giver
    sizes = turns.groupBy(F.col("conv_id").alias("giver")).agg(F.count("*").alias("size"))
    plan = ids.where(~whole).select("conv_id", (F.col("conv_id") - F.col("conv_id") % 5).alias("giver"), given.alias("h")).where("h > 0")
    plan = plan.join(sizes, "giver", "left").select("conv_id", "giver", "h", F.least("h", F.coalesce("size", F.lit(0))).alias("n_given"))
    heads = turns.where("at < 8").withColumnRenamed("conv_id", "giver")
    taken = plan.join(heads, "giver").where("at < n_given").select(*turns.columns)
    # own turns keep their places unless the giver is short
    short = plan.where("n_given < h").select("conv_id", (F.col("h") - F.col("n_given")).alias("back"))
    own = turns.where(whole | (F.col("at") >= given)).join(short, "conv_id", "left").withColumn("at", F.col("at") - F.coalesce("back", F.lit(0)))
    return taken.unionByName(own.select(*turns.columns))


#: members are joined into texts of about this many characters before they meet at their node
MEMBERS_CHARS = 1 << 16


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of members of one node, as comma-joined texts with their first member."""
    kinds = [*[pa.int64()] * 4, pa.string()]
    node, first, ids, size = None, 0, [], 0

    def text():
        return (*node, first, ",".join(ids))

    for batch in batches:
        out = []
        for *at, c in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
            if at != node or size > MEMBERS_CHARS:
                if ids:
                    out.append(text())
                node, first, ids, size = at, c, [], 0
            ids.append(str(c))
            size += len(ids[-1]) + 1
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*out, strict=True), kinds, strict=True)], names=[*prefix_trie.NODE, "first", "members"])
    if ids:
        yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(text(), kinds, strict=True)], names=[*prefix_trie.NODE, "first", "members"])


def _member_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One SHA-256 per node over its texts in order."""
    node, digest = None, None

    def batch_of(rows):
        kinds = [*[pa.int64()] * 3, pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[*prefix_trie.NODE, "ends_sha256"])

    for batch in batches:
        out = []
        for *at, members in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
            if at != node:
                if digest:
                    out.append((*node, digest.hexdigest()))
                node, digest = at, hashlib.sha256(members.encode())
            else:
                digest.update(f",{members}".encode())
        if out:
            yield batch_of(out)
    if digest:
        yield batch_of([(*node, digest.hexdigest())])


TRIE_SQL = f"""
WITH RECURSIVE own AS (
    SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
           row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS pos
    FROM conversations WHERE conv_id IS NOT NULL),
texts AS (SELECT DISTINCT CAST(conv_id AS VARCHAR) AS s FROM own),
{CRC_SQL.format(texts='texts')},
ids AS (SELECT CAST(s AS BIGINT) AS conv_id, h % 9 AS h, CAST(s AS BIGINT) - CAST(s AS BIGINT) % 5 AS giver FROM crc),
turns AS (
    SELECT i.conv_id, 0 AS part, o.pos, o.role, o.text FROM ids i JOIN own o ON o.conv_id = i.giver AND o.pos < i.h
    UNION ALL SELECT i.conv_id, 1, o.pos, o.role, o.text FROM ids i JOIN own o ON o.conv_id = i.conv_id AND o.pos >= i.h),
lists AS (
    SELECT conv_id, list(sha256(CAST(length(role) AS VARCHAR) || ':' || role || text) ORDER BY part, pos) AS keys, list(strlen(text) ORDER BY part, pos) AS sizes FROM turns GROUP BY conv_id),
whole AS (SELECT i.conv_id, coalesce(l.keys, []) AS keys, coalesce(l.sizes, []) AS sizes FROM ids i LEFT JOIN lists l USING (conv_id)),
paths AS (
    SELECT conv_id, d AS depth, md5(array_to_string(keys[1:d], ',')) AS node, CASE WHEN d > 0 THEN md5(array_to_string(keys[1:d - 1], ',')) END AS parent,
           CASE WHEN d > 0 THEN sizes[d] ELSE 0 END AS size, d = len(keys) AS ends
    FROM (SELECT *, unnest(range(0, len(keys) + 1)) AS d FROM whole)),
nodes AS (
    SELECT depth, node, any_value(parent) AS parent, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(size) AS saved,
           sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
    FROM paths GROUP BY depth, node),
kids AS (SELECT depth - 1 AS depth, parent AS node, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY depth, parent),
up AS (
    SELECT depth, node, depth AS d, node AS pos, parent, saved FROM nodes
    UNION ALL SELECT u.depth, u.node, n.depth, n.node, n.parent, u.saved FROM up u JOIN nodes n ON n.depth = u.d - 1 AND n.node = u.parent),
below AS (
    SELECT u.d AS depth, u.pos AS node, sum(u.saved) AS saved_tokens, count(*) FILTER (k.node IS NULL) AS n_leaves
    FROM up u LEFT JOIN kids k ON k.depth = u.depth AND k.node = u.node GROUP BY u.d, u.pos)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n_children, 0) AS n_children, b.n_leaves, CAST(b.saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
FROM nodes n JOIN below b USING (depth, node) LEFT JOIN kids k USING (depth, node) LEFT JOIN nodes p ON p.depth = n.depth - 1 AND p.node = n.parent
"""


@query("op11_prefix_trie", sql=TRIE_SQL)
def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    turns = prefix_trie.turns_of(conversations)
    ids = turns.select("conv_id").distinct()
    trie = prefix_trie.build_trie(rebuilt(turns, ids), ids)
    node = ", ".join(f"{c} long" for c in prefix_trie.NODE)
    ends = materialise(trie.ends, "trie-ends").select(*prefix_trie.NODE, "conv_id")
    # members in order by ranges, so the many of one node are joined in several tasks; their few texts are hashed one after the other
    runs = ends.repartitionByRange(*ends.columns).sortWithinPartitions(*ends.columns).mapInArrow(_members, f"{node}, first long, members string")
    hashes = runs.repartition(*prefix_trie.NODE).sortWithinPartitions(*prefix_trie.NODE, "first").select(*prefix_trie.NODE, "members").mapInArrow(_member_hashes, f"{node}, ends_sha256 string")
    return trie.nodes.join(hashes, prefix_trie.NODE, "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"))
