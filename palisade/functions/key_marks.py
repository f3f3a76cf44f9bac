"""Marks of hashed keys: rows that surely have no partner go before a shuffle."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.functions.text import each

#: lists that the marks are dealt to by some bits of their hash
LISTS = 1 << 12
#: marks of a key, and bits that a list has for each mark, at least; a mark sets two of them, in one word
PROBES, ROOM = 3, 8


def key_hash(*columns: Column | str) -> Column:
    return F.xxhash64(*columns)


def key_probes(key: Column) -> list[Column]:
    """The marks of a hashed key: all of them are there if the key is."""
    return [key, *[F.xxhash64(key, F.lit(i)) for i in range(1, PROBES)]]


def _list_of(mark: Column) -> Column:
    return mark.bitwiseAND(LISTS - 1).cast("int")


def _bits_of(mark: Column) -> list[Column]:
    return [F.shiftrightunsigned(mark, at).bitwiseAND(63).cast("int") for at in (12, 58)]


def _word_of(mark: Column, words: Column) -> Column:
    """Place in a list of so many words, a power of two."""
    return F.shiftrightunsigned(mark, 18).bitwiseAND(words.cast("bigint") - 1).cast("int")


def key_marks(marks: DataFrame, column: str) -> Column:
    """The hashed marks in a column of ``marks``, as an array of lists of bits: a scalar subquery, evaluated with the query that uses it.

    A list is as long as its marks ask for, so a mark is looked up in one place, and a foreign one is let through as rarely, at any number of them.
    """
    dealt = marks.where(F.col(column).isNotNull()).groupBy(_list_of(F.col(column)).alias("list")).agg(F.collect_set(column).alias("marks"))
    words = F.pow(2.0, F.ceil(F.log2(F.greatest(F.size("marks") * F.lit(ROOM / 64), F.lit(1.0))))).cast("int")
    dealt = dealt.select("list", "marks", words.alias("words"))
    set_bits = lambda m: reduce(Column.bitwiseOR, [F.call_function("shiftleft", F.lit(1).cast("bigint"), b) for b in _bits_of(m)])
    placed = F.transform("marks", lambda m: F.struct(_word_of(m, F.col("words")).alias("word"), set_bits(m).alias("bits")))
    empty = F.transform(F.sequence(F.lit(0), F.col("words") - 1), lambda w: F.struct(w.alias("word"), F.lit(0).cast("bigint").alias("bits")))
    held = (each(dealt, F.concat(placed, empty), "at", "list").groupBy("list", F.col("at.word").alias("word")).agg(F.bit_or("at.bits").alias("bits"))
            .groupBy("list").agg(F.sort_array(F.collect_list(F.struct("word", "bits"))).getField("bits").alias("bits")))
    every = marks.sparkSession.range(0, LISTS, 1, 1).join(held, F.col("id") == F.col("list"), "left")
    return every.agg(F.sort_array(F.collect_list(F.struct("id", "bits"))).getField("bits")).scalar()


def may_hold(held: Column, *marks: Column) -> Column:
    """Not true only if one of the marks is not there. Spark allows no subquery inside array functions' own bodies: name it outside."""
    def one(mark: Column) -> Column:
        bits = F.get(held, _list_of(mark))
        word = F.get(bits, _word_of(mark, F.size(bits)))
        return reduce(Column.__and__, [F.getbit(word, b) == 1 for b in _bits_of(mark)])
    return reduce(Column.__and__, map(one, marks))
