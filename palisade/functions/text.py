"""Text helpers as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# the breaks between two lines of text, and the characters trimmed from both ends
LINE_BREAK = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]"
SPACE = " \t\n\r\x0b\x0c"


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACE))


def unquote(value: Column) -> Column:
    """Trim blanks, then double quotes, then single quotes, then blanks."""
    return strip(F.btrim(F.btrim(strip(value), F.lit('"')), F.lit("'")))


def numbered_lines(content: Column) -> Column:
    """``array<struct<line, text>>``: 1-based lines, without a last empty line."""
    parts = F.split(content, LINE_BREAK)
    kept = F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)
    return F.transform(kept, lambda text, i: F.struct((i + 1).alias("line"), text.alias("text")))


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def file_ext(name: Column) -> Column:
    """Last suffix in lower case; a leading dot alone is no suffix."""
    return F.lower(F.regexp_extract(name, r"^.+(\.[^.]+)$", 1))


def one_of(text: Column, literals) -> Column:
    """True where ``text`` contains any of the literals."""
    test = F.lit(False)
    for literal in literals:
        test = test | text.contains(literal)
    return test


def lit_array(values) -> Column:
    """A literal array; Catalyst folds it to one constant.

    Look up with ``F.get``: ``element_at`` counts as never null here, even for a null position.
    """
    return F.array(*[F.lit(v) for v in values])


def each(df: DataFrame, array: Column, name: str, *keep) -> DataFrame:
    """One row per element of a computed array.

    The outer form is used on purpose: for the inner form Spark adds a filter on the array's size below the
    generator, which would compute the array twice.
    """
    return df.select(*keep, F.explode_outer(array).alias(name)).filter(F.col(name).isNotNull())
