"""The prefix tree of conversations, grouped by blocks of turns first.

Conversations are cut into blocks of ``BLOCK`` turns. A block's digest stands for everything up to its last turn, so conversations with
equal digests share all turns so far; they are grouped by the digests of successive blocks, which needs one row per block and not one per
turn. Only where a group goes on in several different blocks are the turns inside those blocks compared, by their own digests, and one
row per different block does that, however many conversations go through it.

A turn's digest is a sum over all turns so far of a hash of place, role and text: two sums modulo 2^61 from SHA-256, 122 bits. Sums can be
carried from one range of turns into the next, so a conversation of any length is spread over tasks.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.llm.ordering import MASK, in_order
from palisade.llm.tables import materialise, only

BLOCK = 4
NODE = ["depth", "p1", "p2"]


class Trie(NamedTuple):
    """``nodes``: depth, p1, p2 (the node's digest), conv_id (its smallest member), parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens. ``ends``: conv_id and depth, p1, p2 of the node where it ends."""
    nodes: DataFrame
    ends: DataFrame


def turns_of(conversations: DataFrame) -> DataFrame:
    """``conv_id, at, d1, d2, n_bytes``: turns by place, with 60-bit parts of the SHA-256 of role and text, and the text's bytes.

    Turns stand by turn (null first), then role and text; null role or text is empty; rows without conv_id are left out."""
    rows = only(conversations, "conv_id", "turn", "role", "text").where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")])
    sha = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256)
    parts = [F.conv(F.substring(sha, 1 + 15 * i, 15), 16, 10).cast("long").alias(f"d{i + 1}") for i in (0, 1)]
    return in_order(rows, "conv_id", [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")],
                    [F.col("conv_id"), *parts, F.octet_length("text").cast("long").alias("n_bytes")])


def _less(upto: str, own: str) -> Column:
    """A running sum without the row's own part."""
    return (F.col(upto) - F.col(own)).bitwiseAND(MASK)


def _paths(turns: DataFrame) -> DataFrame:
    """Each different block once: the turns in it with their digests, how many conversations go through it, and the smallest."""
    turn = F.struct((F.col("at") + 1).alias("depth"), F.col("x1_upto").alias("p1"), F.col("x2_upto").alias("p2"),
                    _less("x1_upto", "x1").alias("q1"), _less("x2_upto", "x2").alias("q2"), "n_bytes")
    blocks = turns.groupBy("conv_id", F.floor(F.col("at") / BLOCK).alias("block")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    end = F.element_at("turns", -1)
    blocks = blocks.select("conv_id", "turns", *[end[c].alias(c) for c in NODE])
    return blocks.groupBy(*NODE).agg(F.count("*").alias("n_convs"), F.min_by("turns", "conv_id").alias("turns"), F.min("conv_id").alias("conv_id"))


def _nodes(paths: DataFrame) -> DataFrame:
    """The nodes below the root. Turns are grouped by their own digests only in blocks that have siblings."""
    before = F.element_at("turns", 1)
    paths = paths.select("conv_id", "n_convs", "turns", (before["depth"] - 1).alias("b0"), before["q1"].alias("b1"), before["q2"].alias("b2"))
    forks = paths.groupBy("b0", "b1", "b2").agg((F.count("*") > 1).alias("forked"))
    each = paths.join(forks, ["b0", "b1", "b2"]).select("conv_id", "n_convs", "forked", F.explode("turns").alias("turn")).select(
        "forked", "conv_id", "n_convs", "turn.*")
    columns = [*NODE, "q1", "q2", "n_bytes", "n_convs", "conv_id"]
    refined = each.where("forked").groupBy(*NODE).agg(
        *[F.min(c).alias(c) for c in ("q1", "q2", "n_bytes")], F.sum("n_convs").alias("n_convs"), F.min("conv_id").alias("conv_id"))
    return each.where("NOT forked").select(*columns).unionByName(refined.select(*columns))


def build_trie(turns: DataFrame, ids: DataFrame) -> Trie:
    """The tree of the conversations ``ids`` (conv_id, each once; those without turns end at the root), from ``turns`` as ``turns_of`` gives
    them: places from 0 without gaps, each once. No conversations give no nodes.

    A conversation is the smallest member of a run of nodes down its path, which is the top of a chain if it begins below the root. What lies
    below a node is then its own chain's rest and the chains of the other members that begin deeper; each adds its whole sum to the nodes
    above its top, so one grouping gives all subtree sums and no step goes through the depths.
    """
    ids = ids.select("conv_id")
    hashed = [F.shiftrightunsigned(F.xxhash64("at", d, F.lit(i)), 3).alias(x) for i, (d, x) in enumerate((("d1", "x1"), ("d2", "x2")))]
    turns = in_order(turns, "conv_id", [F.col("at")], ["conv_id", F.col("at").alias("place"), "n_bytes", *hashed], ["x1", "x2"])
    turns = turns.drop("at").withColumnRenamed("place", "at")
    nodes = materialise(_nodes(_paths(turns)), "trie-nodes")
    root = ids.agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id")).where("n_convs > 0").select(
        *[F.lit(0).cast("long").alias(c) for c in NODE], *[F.lit(None).cast("long").alias(c) for c in ("q1", "q2")], F.lit(0).cast("long").alias("n_bytes"), "n_convs", "conv_id")
    children = nodes.groupBy((F.col("depth") - 1).alias("depth"), F.col("q1").alias("p1"), F.col("q2").alias("p2")).agg(F.count("*").alias("n_children"))
    nodes = nodes.unionByName(root).join(children, NODE, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    saved = (F.col("n_convs") - 1) * F.col("n_bytes")
    chains = in_order(nodes, "conv_id", [F.col("depth")], [*NODE, "q1", "q2", "conv_id", "n_convs", "n_children", saved.alias("saved")], ["saved"])
    tops = chains.where("at = 0 AND depth > 0")
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("p1").alias("q1"), F.col("p2").alias("q2"), F.col("conv_id").alias("parent_conv_id"))
    tops = tops.join(parents, ["depth", "q1", "q2"]).select(*NODE, F.col("parent_conv_id").alias("above_top"))
    lines = chains.groupBy("conv_id").agg(F.min("depth").alias("top"), F.max(F.struct("depth", "n_children"))["n_children"].alias("below"), F.sum("saved").alias("line_saved"))
    lines = materialise(lines.select("conv_id", "top", "line_saved", (F.col("below") == 0).cast("long").alias("leaf")), "trie-chains")
    shared = turns.join(lines.where("top > 1"), "conv_id").where("at + 1 < top").groupBy(
        (F.col("at") + 1).alias("depth"), F.col("x1_upto").alias("p1"), F.col("x2_upto").alias("p2")).agg(F.sum("line_saved").alias("more_saved"), F.sum("leaf").alias("more_leaves"))
    whole = lines.where("top > 0").agg(F.sum("line_saved").alias("more_saved"), F.sum("leaf").alias("more_leaves"))  # all of them lie below the root
    shared = shared.unionByName(whole.select(*[F.lit(0).cast("long").alias(c) for c in NODE], "more_saved", "more_leaves"))
    found = chains.join(lines, "conv_id").join(shared, NODE, "left").join(tops, NODE, "left")
    found = found.select(
        *NODE, "conv_id", F.when(F.col("depth") > 0, F.coalesce("above_top", "conv_id")).alias("parent_conv_id"), "n_convs", "n_children",
        (F.col("leaf") + F.coalesce("more_leaves", F.lit(0))).alias("n_leaves"),
        (F.col("line_saved") - F.col("saved_upto") + F.col("saved") + F.coalesce("more_saved", F.lit(0))).alias("saved_tokens"))
    last = turns.groupBy("conv_id").agg(F.max(F.struct("at", "x1_upto", "x2_upto")).alias("last"))
    ends = ids.join(last, "conv_id", "left").select("conv_id", *[
        F.coalesce(value, F.lit(0)).cast("long").alias(c) for c, value in zip(NODE, (F.col("last.at") + 1, F.col("last.x1_upto"), F.col("last.x2_upto")), strict=True)])
    return Trie(found, ends)
