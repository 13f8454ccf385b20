"""Column helpers that the text operators share."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Runs of ASCII letters and digits or any non-ASCII characters, after lower_ascii().
ALNUM_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Runs of anything but ASCII white space.
SPACED_WORD = r"[^\x20\x09-\x0D]+"
ASCII_SPACE = " \t\n\x0b\x0c\r"


def lower_ascii(text: Column) -> Column:
    """Lower-cases A-Z alone. lower() does just that on pure ASCII text, and much faster than translate()."""
    is_ascii = F.octet_length(text) == F.char_length(text)
    return F.when(is_ascii, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def words(text: Column, pattern: str) -> Column:
    """All words of the text; a null text has none."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(0))


def fingerprint(text: Column) -> Column:
    """Tells rows with the same id and different texts apart; null has its own value."""
    return F.xxhash64(text, text.isNull())


def kept_runs(dropped: Column, n: Column) -> Column:
    """(start, length) of the stretches that stay of n places when those of `dropped`, in order, go."""
    before, after = F.concat(F.array(F.lit(-1)), dropped), F.concat(dropped, F.array(n))
    gaps = F.zip_with(before, after, lambda a, b: F.struct((a + 1).alias("start"), (b - a - 1).alias("length")))
    return F.filter(gaps, lambda r: r["length"] > 0)


def joined_runs(lines: str, runs: Column) -> Column:
    """The lines of the array column `lines` in the stretches given, joined.

    The column must be used once more beside this, for instance for its size: a column used only inside a
    lambda is moved there, and then made anew for every element.
    """
    return F.array_join(F.flatten(F.transform(runs, lambda r: F.slice(lines, r["start"] + 1, r["length"]))), "\n")


def where_computed(df: DataFrame, condition: Column) -> DataFrame:
    """Filters by computed columns. A plain filter would move below them and compute them anew, lambdas and all."""
    return df.withColumn("_row", F.monotonically_increasing_id()).where((F.col("_row") >= 0) & condition).drop("_row")


def unused(name: str, columns: list[str]) -> str:
    """`name`, or with underscores before it, so that no column has it."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
