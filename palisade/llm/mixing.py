"""Mixing sources to target weights by Pfair scheduling, with built-in expressions only.

Each source is a stream of its documents in hashed order, cut into blocks of equally many characters. A source with share a of a
period of H slots has its block j released at floor(j * H / a) and due at ceil((j + 1) * H / a); earliest deadline first picks the
block of every slot. Shares are whole numbers, so the schedule repeats after H slots: it is worked out once, for a number of
slots that does not depend on the data, and every block finds its slot by arithmetic. In every prefix of slots a source is less
than one block away from its share, until it runs out; its later slots then stay empty and nothing is dropped. A share is the weight
rounded to a whole number of the period's slots, one at least, so weights very far apart are met only roughly.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from palisade.llm.tables import let, materialise

#: characters of a block; slots of a period, up to rounding; characters that one task orders
BLOCK_CHARS, RESOLUTION, BUCKET_CHARS = 65_536, 500, 4_000_000
ADDED = ("mix_block", "mix_release", "mix_deadline", "mix_slot", "mix_offset")


def source_name(source: str) -> Column:
    """A name that is never null: a null source is a source of its own."""
    return F.coalesce(F.concat(F.lit("s"), F.col(source).cast("string")), F.lit("n"))


def earliest_deadline_first(shares: Column, period: Column) -> Column:
    """The source number of each slot of a period, from the shares of all sources."""
    def slot(state: Column, t: Column) -> Column:
        def due(i: Column) -> Column:
            j, a = F.get(state["done"], i), F.get(shares, i)
            ready = (j < a) & (F.floor(j * period / a) <= t)
            return F.when(ready, F.struct(F.ceil((j + 1) * period / a).alias("deadline"), i.alias("i")))
        first = F.array_min(F.transform(F.sequence(F.lit(0), F.size(shares) - 1), due))["i"]
        return let(first, lambda pick: F.struct(
            F.transform(state["done"], lambda n, i: F.when(i == pick, n + 1).otherwise(n)).alias("done"),
            F.concat(state["picked"], F.array(pick)).alias("picked")))
    begin = F.struct(F.transform(shares, lambda _: F.lit(0).cast("long")).alias("done"), F.array().cast("array<int>").alias("picked"))
    return F.aggregate(F.sequence(F.lit(0).cast("long"), period - 1), begin, slot, lambda s: s["picked"])


def schedule(sizes: DataFrame, weights: Mapping[str, float] | None = None, default_weight: float = 1.0, resolution: int = RESOLUTION) -> DataFrame:
    """``name, share, period, turn, slot``: the slots of one period, from ``name, chars`` per source.

    Weights are given by source, others have the default; without weights a source weighs the square root of its characters. Every
    source has one slot at least. One row holds all sources, so their number should stay in the thousands.
    """
    if weights is None:
        weight = F.floor(F.sqrt(F.col("chars").cast("double"))).cast("long")
    else:
        if any(not 0 < w < float("inf") for w in [*weights.values(), default_weight]):
            raise ValueError("weights must be positive and finite")
        scaled = {f"s{k}" if k is not None else "n": round(w * 1e6) for k, w in weights.items()}
        weight = F.lit(round(default_weight * 1e6)).cast("long")
        if scaled:
            given = F.create_map(*[F.lit(x) for pair in scaled.items() for x in pair])
            weight = F.coalesce(F.element_at(given, F.col("name")).cast("long"), weight)
    listed = sizes.select(F.struct("name", F.greatest(weight, F.lit(1).cast("long")).alias("w")).alias("s")).agg(F.array_sort(F.collect_list("s")).alias("s"))
    total = F.aggregate("s", F.lit(0).cast("long"), lambda n, x: n + x["w"])
    shares = let(total, lambda w: F.transform(F.col("s"), lambda x: F.greatest(F.lit(1).cast("long"), F.expr("1L") * F.floor((2 * resolution * x["w"] + w) / (2 * w)))))
    listed = listed.where(F.size("s") > 0).select("s", shares.alias("shares"))
    period = F.aggregate("shares", F.lit(0).cast("long"), lambda n, a: n + a)
    listed = listed.select("s", "shares", period.alias("period"))
    picked = listed.select("s", "shares", "period", earliest_deadline_first(F.col("shares"), F.col("period")).alias("picked"))
    turn = F.row_number().over(Window.partitionBy("i").orderBy("slot")) - 1
    slots = picked.select("s", "shares", "period", F.posexplode("picked").alias("slot", "i"))
    return slots.select(F.get("s", F.col("i"))["name"].alias("name"), F.get("shares", F.col("i")).alias("share"), "period",
                        turn.cast("long").alias("turn"), F.col("slot").cast("long").alias("slot"))


def mix_sources(docs: DataFrame, weights: Mapping[str, float] | None = None, default_weight: float = 1.0, source: str = "source", text: str = "text",
                key: str = "doc_id", block_chars: int = BLOCK_CHARS, resolution: int = RESOLUTION, bucket_chars: int = BUCKET_CHARS, seed: str = "mix") -> DataFrame:
    """Every row with its block of the source, the block's release, deadline and slot, and its offset in the source's stream.

    Sorted by slot, offset the rows are the mixture. A document belongs to the block in which it starts; a null text has no
    characters and goes with the document after it. A null source is a source of its own. Rows that repeat an id are told apart
    by a hash of their text; equal rows share neighbouring offsets in any order. The added columns replace columns of the same
    name. An empty table gives an empty table.

    Offsets are sums over buckets of a source (ranges of the hash, about ``bucket_chars`` each) plus sums inside a bucket, so a
    source with a third of all rows is spread over as many tasks as its size asks for.
    """
    rows = docs.drop(*ADDED)
    columns = rows.columns
    rows = rows.select("*", source_name(source).alias("_name"), F.coalesce(F.length(F.col(text).cast("string")), F.lit(0)).cast("long").alias("_chars"),
                       F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col(key).cast("string"), F.lit(""))).cast("binary")).alias("_hash"),
                       F.xxhash64(text).alias("_tie"))
    # small tables are written, so that their sizes are known and no join has to move a hot source to one task
    sizes = materialise(rows.groupBy(F.col("_name").alias("name")).agg(F.sum("_chars").alias("chars")), "sources")
    buckets = sizes.select(F.col("name").alias("_name"), F.ceil((F.col("chars") + 1) / F.lit(bucket_chars)).cast("long").alias("_buckets"))
    place = F.conv(F.substring("_hash", 1, 7), 16, 10).cast("long")
    rows = rows.join(buckets, "_name").withColumn("_bucket", F.floor(place * F.col("_buckets") / F.lit(1 << 28)).cast("long")).drop("_buckets")
    before = Window.partitionBy("_name").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = materialise(rows.groupBy("_name", "_bucket").agg(F.sum("_chars").alias("_sum")).select(
        "_name", "_bucket", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base")), "buckets")
    inside = Window.partitionBy("_name", "_bucket").orderBy("_hash", "_tie").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_into", F.coalesce(F.sum("_chars").over(inside), F.lit(0))).join(bases, ["_name", "_bucket"])
    rows = rows.withColumn("mix_offset", F.col("_base") + F.col("_into")).withColumn("mix_block", F.floor(F.col("mix_offset") / F.lit(block_chars)).cast("long"))
    slots = materialise(schedule(sizes, weights, default_weight, resolution), "slots")
    shares = slots.groupBy(F.col("name").alias("_name")).agg(F.first("share").alias("_share"), F.first("period").alias("_period"))
    rows = rows.join(shares, "_name").withColumn("_turn", F.col("mix_block") % F.col("_share"))
    rows = rows.join(slots.select(F.col("name").alias("_name"), F.col("turn").alias("_turn"), F.col("slot").alias("_slot")), ["_name", "_turn"])
    first = F.floor(F.col("mix_block") / F.col("_share")).cast("long") * F.col("_period")
    turn, share, period = F.col("_turn"), F.col("_share"), F.col("_period")
    return rows.select(
        *columns, "mix_block", (first + F.floor(turn * period / share)).cast("long").alias("mix_release"),
        (first + F.ceil((turn + 1) * period / share)).cast("long").alias("mix_deadline"), (first + F.col("_slot")).alias("mix_slot"), "mix_offset")
