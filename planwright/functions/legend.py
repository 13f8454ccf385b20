"""The finish legend in the text of a sheet: codes, with the name above, the description beside and the detail below.

A line glues columns of the page together with runs of six or more blanks; what belongs to a code is found by column.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planwright.functions.sheets import neighbours

# Codes, drawing numbers that are no codes, what is no description, and what a detail holds.
CODE = r"\b([A-Z]{2}\d{2})\b"
STRICT = r"^[A-Z]{2}\d{2}$"
SENTINEL = r"(?i)\bBATHROOM\s+FINISHES\b"
SENTINEL_ROW = ("BATHROOM", "BATHROOM FINISHES", "As per Bathroom Drawings")
NOISE = ["I401", "I402", "I403", "I404", "A101", "A102", "A103", "A301", "A302", "A401", "A741"]
NO_DESCRIPTION = [
    r"(?i)^\s*-?\d+(\.\d+)?\s*m[²2]?\s*$",
    r"(?i)^\s*(ground|first|second|third|roof|basement|mezzanine)\s*(floor)?\s*$",
    r"(?i)^\s*(drawing|scale|sheet|revision|project)\b",
]
DETAIL = [r"\d+\s*x\s*\d+", r"(?i)honed|polish|matt|natural|finish|size|colour|color|gloss"]


def _trim(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def segments(line: Column) -> Column:
    """The columns of a line, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(line, r"\s{6,}"), _trim), lambda s: s != "")


def describes(segment: Column) -> Column:
    return (_trim(segment) != "") & ~reduce(Column.__or__, [segment.rlike(p) for p in NO_DESCRIPTION])


def segment_of(line: Column, code: Column) -> Column:
    """The column of a line that holds the code, else the whole line."""
    return F.coalesce(F.get(F.filter(segments(line), lambda s: s.contains(code)), F.lit(0)), _trim(line))


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), the value worked out once for all its uses."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def description(line: Column, code: Column) -> Column:
    """What stands behind the code in its column and in the columns to its right that describe and are no codes; null if nothing does."""

    def of(parts: Column, at: Column) -> Column:
        inline = _once(F.get(parts, at - 1), lambda own: _trim(F.substring(own, F.instr(own, code) + F.length(code), F.length(own))))
        rest = F.filter(F.slice(parts, at + 1, F.size(parts)), lambda s: ~s.rlike(STRICT) & describes(s))
        inline = _once(inline, lambda x: F.when(describes(x), x).otherwise(""))
        joined = F.array_join(F.filter(F.array(inline, F.array_join(rest, " ")), lambda s: s != ""), " ")
        return F.when(at > 0, F.nullif(joined, F.lit("")))

    return _once(segments(line), lambda parts: _once(F.array_position(F.transform(parts, lambda s: s.contains(code)), True), lambda at: of(parts, at)))


def names(segment: Column) -> Column:
    """Mostly capitals, three letters at least."""
    share = lambda letters: (F.length(letters) >= 3) & (F.length(F.regexp_replace(letters, "[^A-Z]", "")) / F.length(letters) >= 0.7)
    return _once(F.regexp_replace(segment, "[^A-Za-z]", ""), share)


def details(segment: Column) -> Column:
    return segment.rlike(DETAIL[0]) | segment.rlike(DETAIL[1])


def legend_rows(sheets: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, code, name, description, detail, line_no): a row for each code of each sheet's `text`, where it stands first; line_no counts from 1.

    The bathroom note counts as a code of its own. Sheets without text have no rows; sheets equal in `keys` are one
    sheet to the extent that the first line of a code, then the smallest text of it, counts. Lines of one sheet are
    read as an array; only lines with a code are moved.
    """
    split = sheets.select(*keys, F.split("text", r"\r?\n").alias("_lines"))
    # Plain explode() would have its input filtered first, with the arrays worked out once more for it.
    coded = neighbours(F.col("_lines"), kept=lambda x: x.rlike(CODE) | x.rlike(SENTINEL))
    lined = split.select(*keys, F.explode_outer(coded).alias("l")).where(F.col("l").isNotNull())
    codes = F.filter(F.regexp_extract_all("l.line", F.lit(CODE), F.lit(1)), lambda c: ~c.isin(NOISE))
    # The note comes before the codes of its line.
    found = F.concat(F.when(F.col("l.line").rlike(SENTINEL), F.array(F.lit(SENTINEL_ROW[0]))).otherwise(F.array().cast("array<string>")), codes)
    placed = lined.select(*keys, "l", F.posexplode_outer(found).alias("place", "code")).where(F.col("code").isNotNull())
    first = placed.groupBy(*keys, "code").agg(F.min(F.struct(F.col("l.line_no").alias("no"), "place", F.col("l.line").alias("line"), F.col("l.previous").alias("previous"), F.col("l.next").alias("next"))).alias("f"))
    read = first.select(*keys, "code", "f", segment_of(F.col("f.previous"), F.col("code")).alias("_above"), segment_of(F.col("f.next"), F.col("code")).alias("_below"))
    code, above, below = F.col("code"), F.col("_above"), F.col("_below")
    note = code == SENTINEL_ROW[0]
    return read.select(
        *keys, "code", F.when(note, SENTINEL_ROW[1]).when(names(above) & describes(above), above).alias("name"), F.when(note, SENTINEL_ROW[2]).otherwise(description(F.col("f.line"), code)).alias("description"),
        F.when(~note & details(below), below).alias("detail"), (F.col("f.no") + 1).alias("line_no"))
