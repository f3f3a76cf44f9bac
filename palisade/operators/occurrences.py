"""Find many literal values in many texts, exactly and without comparing all pairs.

A value is known by the last ``size`` bytes of its last unbroken run of as many characters, or, if it has none, by its last ``size`` bytes:
tokens of one kind begin alike and end differently. Whatever contains the value has this key among its pieces of ``size`` bytes, so the hash of
the key is an equi-join key. Marks of the values' keys drop the pieces of the texts that are no key before they are shuffled, at any
number of values, and the survivors carry the stretch of text that they were found in, in which the value is then compared in full.

Not every piece of a text is hashed: a key, wherever it lies, holds one whole block of the text, of those that begin at every few bytes. Only
around blocks that some key of the project may hold are the pieces looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.functions.key_marks import key_hash, key_marks, key_probes, may_hold
from palisade.functions.text import LINE_BREAK, each

WINDOW = 16
SALTS = 16
#: texts beyond this many characters are looked at stretch by stretch; a piece that is a key carries its stretch
STRETCH = 1 << 13
STREAM_STRETCH = 1 << 18

# unbroken runs, the only places of values that hold one; the few values made of short words may lie anywhere
_DENSE = r"\S{%d,}"


def _blocks(size: int) -> tuple[int, int]:
    """Every how many bytes a block of a text begins, and the bytes it has: a piece of ``size`` bytes holds one, at any place."""
    stride = max(1, size // 3)
    return stride, size - stride + 1


def _key(value: Column, size: int) -> Column:
    """The last ``size`` bytes of a value."""
    return F.substring(value.cast("binary"), -size, size)


def _block_marks(project: Column, key: Column, size: int) -> list[Column]:
    """Marks of the blocks that a text may have in a key, as the key may begin up to a stride before one."""
    stride, block = _blocks(size)
    return [key_hash(F.substring(key, at + 1, block)).bitwiseXOR(project) for at in range(stride)]


def _runs(text: Column, anywhere: Column, size: int) -> Column:
    """The stretches of a text that a value may lie in."""
    whole = F.when(F.octet_length(text) >= size, F.array(text)).otherwise(F.array().cast("array<string>"))
    return F.when(anywhere, whole).otherwise(F.array_distinct(F.regexp_extract_all(text, F.lit(_DENSE % size), F.lit(0))))


def _known_hashes(known: Column, run: Column, size: int) -> Column:
    """Hashes of the pieces of ``size`` bytes of a run, given as bytes and as long, that may be keys of its project."""
    held, project = known["marks"], known["project"]
    stride, block = _blocks(size)
    blocks = F.transform(F.sequence(F.lit(1), F.length(run) - (block - 1), F.lit(stride)), lambda at: key_hash(F.substring(run, at, block)).bitwiseXOR(project))
    hits = F.array_compact(F.transform(blocks, lambda mark, i: F.when(may_hold(held, mark), i * stride + 1)))
    around = lambda at: F.sequence(F.greatest(at - (stride - 1), F.lit(1)), F.least(at, F.length(run) - (size - 1)))
    pieces = F.flatten(F.transform(hits, lambda at: F.transform(around(at), lambda place: key_hash(F.substring(run, place, size)))))
    return F.filter(pieces, lambda h: may_hold(held, *key_probes(h.bitwiseXOR(project))))


def _stretches(texts: DataFrame, keep: list[str], longest: Column, size: int) -> DataFrame:
    """``keep``, ``_part`` (a stretch and as much of what follows as a value may have) and ``_before`` (line breaks before it)."""
    pieces = F.regexp_extract_all("text", F.lit(rf"(?s).{{1,{size}}}(?:(?<=\r)\n)?"), F.lit(0))  # no cut inside a line break
    cut = texts.select(*keep, F.when(F.length("text") <= size, F.array("text")).otherwise(pieces).alias("_pieces"))
    cut = cut.select(*keep, "_pieces", F.transform("_pieces", lambda p: F.size(F.split(p, LINE_BREAK)) - 1).alias("_breaks"))
    cut = cut.select(*keep, "_pieces", "_breaks", F.posexplode("_pieces").alias("_at", "_piece"))
    more = F.array_join(F.slice("_pieces", F.col("_at") + 2, F.ceil(longest / size).cast("int")), "")
    before = F.aggregate(F.slice("_breaks", F.lit(1), F.col("_at")), F.lit(0), lambda n, b: n + b)
    return cut.select(*keep, F.when(F.size("_pieces") == 1, F.col("_piece")).otherwise(F.concat("_piece", F.left(more, longest))).alias("_part"), before.alias("_before"))


def literal_occurrences(texts: DataFrame, values: DataFrame, text_id: list[str], size: int = WINDOW,
                        broadcast: bool | None = None, salts: int = SALTS) -> DataFrame:
    """``project_id, text_id...``, the columns of ``values`` and ``line`` (of the first occurrence, from 1), for every value contained in
    a text of its project: one row per text and row of ``values``.

    ``texts``: ``project_id``, the ``text_id`` columns (a unique key with ``project_id``) and ``text``.
    ``values``: ``project_id, value`` and any others; each value at least ``size`` characters long and free of line breaks.
    ``broadcast``: ``None`` leaves it to Spark, which knows the size of the value side; ``True`` asks for a broadcast; ``False``
    shuffles both sides by (project, key, salt), so one project or one value that occurs everywhere is spread over ``salts`` tasks.

    Nothing runs before the result is used. On a stream the join has one static side and keeps no state, whatever the size of that
    side; a text of more than ``STREAM_STRETCH`` characters can then give a value once per stretch, as only state could tell.
    """
    named = [c for c in values.columns if c not in ("project_id", "value")]
    dense = F.nullif(F.regexp_extract("value", rf"(?s)^.*(\S{{{size}}})", 1), F.lit(""))
    project = key_hash("project_id")
    keys = values.select("project_id", "value", *named, _key(F.coalesce(dense, "value"), size).alias("_key"), dense.isNull().alias("_short_words"))
    keys = keys.withColumn("_h", key_hash("_key"))
    # the marks hold the keys and their blocks, and the projects with values made of short words
    owner = key_probes(key_hash("project_id", F.lit("short words")))
    marks = F.concat(F.array(*_block_marks(project, F.col("_key"), size), *key_probes(F.col("_h").bitwiseXOR(project))),
                     F.when(F.col("_short_words"), F.array(*owner)).otherwise(F.array().cast("array<bigint>")))
    held = key_marks(each(keys, marks, "mark"), "mark")
    longest = F.coalesce(values.agg(F.max(F.length("value"))).scalar(), F.lit(0))
    parts = _stretches(texts, ["project_id", *text_id], longest, STREAM_STRETCH if texts.isStreaming else STRETCH)
    kept = ["project_id", *text_id, "_part", "_before"]
    # foreign pieces go inside the row, as an exploded row copies its stretch; the marks are named once, so Spark puts their subquery in place
    runs = _runs(F.col("_part"), may_hold(held, *owner), size)
    known = parts.select(*kept, F.struct(held.alias("marks"), project.alias("project"), runs.alias("runs")).alias("_all"))
    of_runs = lambda t: F.transform(F.transform(t["runs"], lambda run: run.cast("binary")), lambda run: _known_hashes(t, run, size))
    own = F.transform(F.array("_all"), lambda t: F.flatten(of_runs(t)))
    spread = each(known.select(*kept, F.array_distinct(F.flatten(own)).alias("_own")), F.col("_own"), "_h", *kept)
    keys = keys.drop("_key", "_short_words")
    if broadcast:
        pairs = spread.join(F.broadcast(keys), ["project_id", "_h"])
    elif broadcast is None:
        pairs = spread.join(keys, ["project_id", "_h"])
    else:
        salt = F.pmod(F.xxhash64(*text_id), F.lit(salts)).cast("int")
        copies = keys.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).hint("merge")
        pairs = spread.withColumn("_salt", salt).join(copies, ["project_id", "_h", "_salt"])
    found = F.instr(F.col("_part"), F.col("value"))
    line = F.col("_before") + F.size(F.split(F.left("_part", found - 1), LINE_BREAK))
    found = pairs.where(F.contains("_part", "value")).select("project_id", *text_id, "value", *named, line.cast("int").alias("line"))
    if texts.isStreaming:
        return found
    # a value may lie in several stretches of a text
    return found.groupBy("project_id", *text_id, "value", *named).agg(F.min("line").alias("line"))
