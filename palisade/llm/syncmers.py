"""Document fingerprints of closed syncmers, with built-in expressions only.

A text is read as symbols: runs of up to four letters or digits that begin anew at every word, and single other visible
characters. A window of K symbols is an anchor if the smallest hash of its S-symbol substrings lies at its first or last place.
Whether a window is an anchor depends on its own symbols alone, so equal passages have equal anchors wherever they stand.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from palisade.llm.tables import let

#: letters or digits of one symbol at most, symbols of an anchor, symbols of its inner substrings
SYMBOL, K, S = 4, 10, 4
_PATTERN = rf"[\p{{L}}\p{{M}}\p{{N}}]{{1,{SYMBOL}}}|[^\p{{L}}\p{{M}}\p{{N}}\s]"


def anchors(text: Column) -> Column:
    """``array<struct<hash, pos>>`` of a text in the order of its symbols. A text with fewer than K symbols is one anchor at 0."""
    inner = K - S + 1

    def windows(n: Column, size: int) -> Column:
        return F.sequence(F.lit(0), n - size)

    def found(sub: Column) -> Column:
        def at(i: Column) -> Column:
            first, last = F.get(sub, i), F.get(sub, i + (inner - 1))
            least = F.array_min(F.slice(sub, i + 1, inner))
            # "in" works the minimum out once, two comparisons would do so twice
            return F.when(least.isin(first, last), F.struct(F.xxhash64(first, F.get(sub, i + inner // 2), last).alias("hash"), i.alias("pos")))
        return F.filter(F.transform(windows(F.size(sub), inner), at), lambda a: a.isNotNull())

    def substrings(h: Column) -> Column:
        return F.transform(windows(F.size(h), S), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(S)]))

    whole = F.array(F.struct(F.xxhash64(text).alias("hash"), F.lit(0).alias("pos")))
    hashed = F.transform(F.regexp_extract_all(F.lower(text), F.lit(_PATTERN), F.lit(0)), lambda s: F.xxhash64(s))
    full = let(hashed, lambda h: F.when(F.size(h) >= K, let(substrings(h), found)))
    none = F.filter(whole, lambda a: F.lit(False))
    return F.when(text == "", none).otherwise(F.coalesce(full, whole))


def fingerprint_text(found: Column) -> Column:
    """Anchors as text: position and hash of each, both hexadecimal."""
    return F.lower(F.array_join(F.transform(found, lambda a: F.concat(F.hex(a["pos"]), F.lit(":"), F.substring(F.hex(a["hash"]), -8, 8))), " "))


def hashes_of(found: Column) -> Column:
    """The distinct hashes of a fingerprint."""
    return F.array_distinct(F.transform(found, lambda v: v["hash"]))


def likeness(x: Column, y: Column) -> Column:
    """Shared hashes over all hashes of two fingerprints, each given by ``hashes_of``; 1 if neither has any."""
    return let(F.size(F.array_intersect(x, y)), lambda both: F.when(F.size(x) + F.size(y) == 0, F.lit(1.0)).otherwise(
        both / (F.size(x) + F.size(y) - both)))


def shared_offsets(a: Column, b: Column) -> Column:
    """How far each shared anchor of ``a`` is moved in ``b`` (first place of each hash): equal offsets are one passage."""
    return F.filter(
        F.transform(a, lambda v: F.try_element_at(F.transform(F.filter(b, lambda w: w["hash"] == v["hash"]), lambda w: w["pos"] - v["pos"]), F.lit(1))),
        lambda o: o.isNotNull())


def with_next_text(docs: DataFrame, key: str = "doc_id", text: str = "text", target: int = 1000, mark: Callable[[Column], Column] | None = None) -> DataFrame:
    """Rows with ``next_text``: the text of the next row by descending ``key`` (nulls last, ties by hash of the text), cyclically.

    ``mark`` is worked out once per text and added as ``mark``, that of the next text as ``next_mark``; it must not be null. Ids are cut into ranges of about ``target`` rows; the width comes from the middle 98 percent of ids, so far-off ids do not
    widen it. A range is one window partition; the last row of each takes the first text of the next range that has rows.
    """
    low, high, n = docs.agg(F.percentile_approx(key, 0.01), F.percentile_approx(key, 0.99), F.count("*")).first()
    width = max(1, round((high - low + 1) * target / max(n, 1))) if low is not None else 1
    ranged = docs.withColumn("_range", F.floor(F.col(key) / F.lit(width)).cast("long")).withColumn("_tie", F.xxhash64(text))
    ranged = ranged.withColumn("_range", F.coalesce("_range", F.lit(-(1 << 62))))
    down = [F.col(key).desc_nulls_last(), F.col("_tie").desc()]
    firsts = ranged.groupBy("_range").agg(F.max_by(text, F.struct(F.coalesce(F.col(key), F.lit(-(1 << 63))), "_tie")).alias("_first"))
    order = Window.orderBy(F.desc("_range"))  # one row per range, ids only
    following = ranged.select("_range").distinct().select("_range", F.lead("_range").over(order).alias("_below"), F.max("_range").over(Window.partitionBy()).alias("_top"))
    following = following.select("_range", F.coalesce("_below", "_top").alias("_below")).join(
        firsts.withColumnRenamed("_range", "_below"), "_below").select("_range", "_first")
    inside = Window.partitionBy("_range").orderBy(*down)
    if mark is not None:
        # between the window's shuffle and the window, so that marks are neither shuffled nor worked out again for the row before
        ranged = ranged.repartition("_range").sortWithinPartitions("_range", *down).withColumn("mark", mark(F.col(text)))
        following = following.withColumn("_first_mark", mark(F.col("_first")))
        ranged = ranged.withColumn("next_mark", F.lead("mark").over(inside))
    found = ranged.withColumn("_lead", F.struct(F.lead(text).over(inside).alias("t"))).join(following, "_range")
    found = found.withColumn("next_text", F.coalesce(F.col("_lead")["t"], "_first"))
    if mark is not None:
        found = found.withColumn("next_mark", F.coalesce("next_mark", "_first_mark")).drop("_first_mark")
    return found.drop("_range", "_tie", "_lead", "_first")


def fingerprint_edits(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document its fingerprint, that of its edited text, and the likeness to both the edited and the next text.

    The edited text has the last floor(n / 3) code points replaced by the first as many (or all) of the next document. A null
    text is empty: its fingerprint has no anchors and is like another empty one only. Rows that repeat an id follow each other;
    rows without id come last. A single row is its own next. An empty table gives an empty table; other columns are ignored.
    """
    rows = with_next_text(docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")),
                          "doc_id", "text", mark=anchors)
    third = F.floor(F.length("text") / 3).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.length("text") - third), F.substring(F.col("next_text"), F.lit(1), third))
    rows = rows.select("doc_id", F.length("text").cast("long").alias("n_chars"), "mark", "next_mark", edited.alias("edited"))
    # arrays are bound once per row: a projection that used them by name could compute them again for every use
    marks = F.struct(F.col("mark").alias("own"), anchors(F.col("edited")).alias("edited"), F.col("next_mark").alias("next"))
    result = let(marks, lambda m: let(
        F.struct(hashes_of(m["own"]).alias("own"), hashes_of(m["edited"]).alias("edited"), hashes_of(m["next"]).alias("next")),
        lambda h: F.struct(
            fingerprint_text(m["own"]).alias("fingerprint"), fingerprint_text(m["edited"]).alias("edited_fingerprint"),
            likeness(h["own"], h["edited"]).alias("near_edited"), likeness(h["own"], h["next"]).alias("near_next"),
            F.size(m["own"]).alias("n_anchors"))))
    return rows.select("doc_id", "n_chars", F.sha2(F.encode(F.col("edited"), "UTF-8"), 256).alias("edited_sha256"), result.alias("r")).select(
        "doc_id", "n_chars", "edited_sha256", "r.fingerprint", "r.edited_fingerprint", "r.near_edited", "r.near_next", "r.n_anchors")
