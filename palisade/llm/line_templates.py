"""Line deduplication by a log-template tree, with built-in expressions only.

A line is parsed in fixed depth: the number of its tokens, then its leading tokens, lead to a leaf. Tokens with digits are
variable. In a leaf, a token that enough of the lines have at a place is constant there; every other place of a line is variable.
Lines with the same constants have one template, if those make up most of the line; other lines stand for themselves. A template
in two or more documents recurs: its first line stays, all others are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.llm.tables import materialise

#: leading tokens of a leaf, tokens of a line that can be dropped, share of a leaf's lines with a constant, share of constants
DEPTH, LEAST_TOKENS, SUPPORT, SIMILAR = 3, 4, 0.2, 0.6
SPACES = r"[ \t\r\f]+"


def tokens(line: Column) -> Column:
    """Tokens of a line, with a star for each that holds a digit; an empty line has one empty token."""
    masked = F.when(line.rlike("[0-9]"), F.regexp_replace(line, r"[^ \t\r\f]*[0-9][^ \t\r\f]*", "<*>")).otherwise(line)
    return F.split(F.btrim(masked, F.lit(" \t\r\f")), SPACES)


def _lines(docs: DataFrame, text: str) -> DataFrame:
    """One row per line with enough tokens: document, place, leaf, hash of the masked line, tokens."""
    lines = docs.select("_id", "_text_hash", F.posexplode(F.split(F.col(text), "\n")).alias("_at", "_line"))
    lines = lines.select("_id", "_text_hash", "_at", tokens(F.col("_line")).alias("_tokens")).where(F.size("_tokens") >= LEAST_TOKENS)
    return lines.select("_id", "_text_hash", "_at", "_tokens", F.size("_tokens").alias("_n"),
                        F.xxhash64(F.size("_tokens"), F.slice("_tokens", 1, DEPTH)).alias("_leaf"), F.xxhash64("_tokens").alias("_masked"))


def bits_of(keys: DataFrame, column: str) -> DataFrame:
    """A bitmap of hashed keys, 2^17 rows at most whatever their number: small enough to broadcast always."""
    bit = F.pmod(F.xxhash64(column), F.lit(1 << 23))
    return keys.select(F.shiftright(bit, 6).cast("int").alias("_word"), bit.alias("_bit")).groupBy("_word").agg(
        F.expr("bit_or(shiftleft(1L, cast(_bit % 64 as int)))").alias("_bits"))


def maybe_in(rows: DataFrame, column: str, bits: DataFrame) -> DataFrame:
    """Rows with ``_maybe``: false where the key surely is not among those of the bitmap."""
    bit = F.pmod(F.xxhash64(column), F.lit(1 << 23))
    marked = rows.withColumn("_bit", bit).withColumn("_word", F.shiftright("_bit", 6).cast("int")).join(F.broadcast(bits), "_word", "left")
    held = F.coalesce(F.expr("shiftright(_bits, cast(_bit % 64 as int)) & 1") == 1, F.lit(False))
    return marked.withColumn("_maybe", held).drop("_word", "_bit", "_bits")


def _document() -> Column:
    """What makes rows one document: id and text. Equal texts of two ids are two documents."""
    return F.struct("_id", "_text_hash")


def template_keys(docs: DataFrame, text: str, lines: DataFrame) -> DataFrame:
    """``_masked, _template`` of the lines that share a template with different lines."""
    leaves = lines.groupBy("_leaf").agg(F.min("_masked").alias("a"), F.max("_masked").alias("b"), F.min(_document()).alias("c"), F.max(_document()).alias("d"))
    mixed = materialise(leaves.where("a < b AND c < d").select("_leaf"), "leaves")
    chosen = maybe_in(_lines(docs, text), "_leaf", bits_of(mixed, "_leaf")).where("_maybe").select(
        "_leaf", "_masked", "_n", F.transform("_tokens", lambda t, i: F.xxhash64(i, t)).alias("_placed"))
    distinct = chosen.groupBy("_leaf", "_masked").agg(F.first("_placed").alias("_placed"), F.first("_n").alias("_n"), F.count("*").alias("_lines"))
    distinct = materialise(distinct.join(mixed, "_leaf", "left_semi"), "leaf-lines")
    total = distinct.groupBy("_leaf").agg(F.sum("_lines").alias("_all"))
    support = distinct.select("_leaf", F.explode("_placed").alias("_token"), "_lines").groupBy("_leaf", "_token").agg(F.sum("_lines").alias("_has"))
    # at most 1 / SUPPORT tokens for each place of a leaf's lines
    constant = support.join(total, "_leaf").where((F.col("_has") >= 2) & (F.col("_has") >= F.col("_all") * F.lit(SUPPORT))).groupBy("_leaf").agg(
        F.collect_set("_token").alias("_constant"))
    kept = distinct.join(constant, "_leaf").select("_leaf", "_masked", "_n", F.array_intersect("_placed", "_constant").alias("_kept"))
    kept = kept.where(F.size("_kept") >= F.col("_n") * F.lit(SIMILAR))
    return kept.select("_masked", F.xxhash64("_leaf", F.array_sort("_kept")).alias("_template"))


def drop_recurring_lines(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Every row with its text without recurring lines, and ``n_lines``, ``n_dropped``.

    The first line of a template, by id and place, stays; lines of fewer than LEAST_TOKENS tokens always stay. Recurring means in
    rows that differ in id or text. Rows equal in id and text share one fate; a null id comes before all others. A null text stays
    null, with no lines; a text that loses all its lines becomes empty. The added columns replace columns of the same name. An
    empty table gives an empty table.
    """
    columns = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    rows = docs.select(*columns).withColumn("_id", F.col(key)).withColumn("_text_hash", F.xxhash64(F.col(text)))
    lines = materialise(_lines(rows, text).drop("_tokens"), "parsed")
    templates = materialise(template_keys(rows, text, lines), "templates")
    lines = lines.join(templates, "_masked", "left").select("_id", "_text_hash", "_at", F.coalesce("_template", "_masked").alias("_template"))
    lines = materialise(lines, "lines")
    recurring = lines.groupBy("_template").agg(
        F.min(F.struct("_id", "_text_hash", "_at")).alias("_first"), F.min(_document()).alias("a"), F.max(_document()).alias("b")).where("a < b")
    dropped = lines.join(recurring.select("_template", "_first"), "_template").where(
        ~F.struct("_id", "_text_hash", "_at").eqNullSafe(F.col("_first")))
    dropped = dropped.groupBy("_id", "_text_hash").agg(F.collect_set("_at").alias("_dropped"))
    dropped = materialise(dropped, "dropped")
    marked = maybe_in(rows, "_text_hash", bits_of(dropped, "_text_hash"))
    split = F.split(F.col(text), "\n")
    count = F.coalesce(F.length(text) - F.length(F.replace(F.col(text), F.lit("\n"), F.lit(""))) + 1, F.lit(0)).cast("long")
    untouched = marked.where("NOT _maybe").select(*columns, count.alias("n_lines"), F.lit(0).cast("long").alias("n_dropped"))
    kept = let_lines(split)
    cut = dropped.select(F.col("_id").alias("_cut_id"), F.col("_text_hash").alias("_cut_hash"), "_dropped")
    hit = marked.where("_maybe").join(cut, F.col("_id").eqNullSafe(F.col("_cut_id")) & (F.col("_text_hash") == F.col("_cut_hash")), "left")
    hit = hit.select(*[F.when(F.col("_dropped").isNull(), F.col(text)).otherwise(kept).alias(text) if c == text else F.col(c) for c in columns],
                     count.alias("n_lines"), F.coalesce(F.size("_dropped"), F.lit(0)).cast("long").alias("n_dropped"))
    return untouched.unionByName(hit)


def let_lines(split: Column) -> Column:
    """The lines whose places are not dropped, joined again."""
    return F.array_join(F.filter(split, lambda _, i: ~F.array_contains(F.col("_dropped"), i)), "\n")
