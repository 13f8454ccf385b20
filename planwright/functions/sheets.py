"""Expressions on sheets, their titles and the lines of their text: schedules, scales, disciplines, neighbours."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"-?\d+(?:\.\d+)?"
#: What follows the tag on rows of data: a count and a decimal width, or two decimal sizes.
DOOR_ROW = r"^\s+\d{1,3}\s+\d+\.\d+"
WINDOW_ROW = r"^\s+\d+\.\d+\s+\d+\.\d+"
#: A floor and all behind it, at the end of window rows; fixed values.
FLOOR_BEHIND = r"(?is)\s+(GROUND FLOOR|FIRST FLOOR|ROOF|BASEMENT|MEZZANINE)\b.*$"
#: Label of a declared area, and the number with its unit; fixed values.
AREA_LABEL = r"(?i)(?:BUA|BUILT[\s-]*UP\s*AREA)"
_SEPARATED = r"([0-9]{1,3}(?:[,. ][0-9]{3})*(?:\.[0-9]{1,2})?)"
IN_M2, IN_FT2, AFTER_FT2 = rf"(?i){_SEPARATED}\s*(?:m\s*²|m2|sqm|m\.?\s*sq\.?)", rf"(?i){_SEPARATED}\s*(?:SQ\s*\.?\s*FT|sqft)", rf"(?i)(?:SQ\s*\.?\s*FT|sqft)\s+{_SEPARATED}"
FT2 = 0.09290304
#: Codes on a legend, at least and at most; fixed values.
LEGEND_CODES = (8, 25)


def legend_category(kind: Column) -> Column:
    return F.when(kind == "WALL", "WALL_FINISH").when(kind == "CEILING", "CEILING").when(kind.isin("FLOOR", "EXTERNAL"), "FLOOR_FINISH").otherwise("OTHER")


def schedule_kind(title: Column, drawing_no: Column) -> Column:
    """DOOR, WINDOW or null from title and number of a sheet; doors win."""
    text = F.lower(F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(drawing_no, F.lit(""))))
    return F.when(text.contains("door"), "DOOR").when(text.rlike(r"window|curtain[\s_-]*wall|glazing|panel|\bcw\b|^cw"), "WINDOW")


def discipline(found: Column, drawing_no: Column) -> Column:
    """The discipline, or UNKNOWN if the drawing number begins with another letter than its sheets have; no number disproves nothing."""
    first = F.upper(F.substring(F.trim(F.coalesce(drawing_no, F.lit(""))), 1, 1))
    wrong = (first != "") & (((found == "MEP") & ~first.isin("M", "E", "P")) | ((found == "STR") & (first != "S")))
    return F.when(wrong, "UNKNOWN").otherwise(found)


def scale_denominator(text: Column) -> Column:
    """75 of `1:75` or `1 / 75`; two to four digits, null for 0 and other text."""
    n = F.regexp_extract(text, r"1\s*[:/]\s*(\d{2,4})", 1).try_cast("int")
    return F.when(n > 0, n)


def room_label(text: Column) -> Column:
    """struct(kind, code, area, name): `GF-04 58.82 m²` is code-area, other text with a letter and at most 60 characters name, the rest unknown."""
    pattern = r"(?i)^([A-Z]{1,4}-\d{1,3})\s+([\d.,]+)\s*(?:m²|m2|sqm|m\^2|m)(?![A-Za-z0-9_])"
    t = F.trim(text)
    area = F.regexp_extract(F.regexp_replace(F.regexp_extract(t, pattern, 2), "^([^,]*),", "$1."), r"^\d*\.?\d+|^\d+", 0).try_cast("double")
    coded = t.rlike(pattern)
    kind = F.when(coded & area.isNotNull(), "code-area").when(~coded & (F.length(t) <= 60) & t.rlike("[A-Za-z]"), "name").otherwise("unknown")
    return F.struct(kind.alias("kind"), F.when(kind == "code-area", F.upper(F.regexp_extract(t, pattern, 1))).alias("code"), F.when(kind == "code-area", area).alias("area"), F.when(kind == "name", t).alias("name"))


def _mm(n: Column) -> Column:
    """Sizes under 50 are metres; null unless above 0."""
    return F.when(n > 0, F.floor(F.when(n < 50, n * 1000).otherwise(n) + 0.5).cast("int"))


def _is_count(n: Column) -> Column:
    return (n == F.floor(n)) & (n > 0) & (n < 200)


def schedule_row(line: Column, tag: Column, kind: str) -> Column:
    """struct(count, width_mm, height_mm) of a schedule's text line, what follows the tag: doors have count, width and height, or no count; windows width, height and count. Nulls for captions and headers."""
    line = line if kind == "DOOR" else F.regexp_replace(line, FLOOR_BEHIND, "")
    # A tag may come again at the end of the line; the row is what follows its first place.
    rest = F.when(F.instr(line, tag) > 0, F.substring(line, F.instr(line, tag) + F.length(tag), F.length(line)))
    numbers = F.transform(F.regexp_extract_all(rest, F.lit(NUMBER), F.lit(0)), lambda x: x.cast("double"))
    at = lambda k: F.get(numbers, F.lit(k))
    triple = lambda c, w, h: F.struct(c.cast("int").alias("count"), w.alias("width_mm"), h.alias("height_mm"))
    none = F.lit(None).cast("int")
    if kind == "DOOR":
        row = F.when(_is_count(at(0)), triple(at(0), _mm(at(1)), _mm(at(2)))).otherwise(triple(none, _mm(at(0)), _mm(at(1))))
        return F.when(rest.rlike(DOOR_ROW), row).otherwise(triple(none, none, none))
    return F.when(rest.rlike(WINDOW_ROW), triple(F.when(_is_count(at(2)), at(2)), _mm(at(0)), _mm(at(1)))).otherwise(triple(none, none, none))


def neighbours(lines: Column, reach: int = 4, kept: Callable[[Column], Column] | None = None) -> Column:
    """For each line of an array, struct(line_no, line, previous, next): the nearest lines that are not blank, `reach` lines away at most.

    `kept` says which lines are wanted. `lines` should be a column, as an expression would be worked out again for every line.
    """
    filled = lambda part: F.filter(part, lambda x: x.rlike(r"\S"))

    def around(x: Column, i: Column) -> Column:
        before = filled(F.slice(lines, F.greatest(i + 1 - reach, F.lit(1)), F.least(i, F.lit(reach))))
        after = filled(F.slice(lines, i + 2, F.lit(reach)))
        return F.struct(i.cast("long").alias("line_no"), x.alias("line"), F.element_at(F.concat(F.array(F.lit(None).cast("string")), before), -1).alias("previous"), F.get(after, F.lit(0)).alias("next"))

    if kept is None:
        return F.transform(lines, around)
    placed = F.transform(lines, lambda x, i: F.struct(i.alias("i"), x.alias("x")))
    return F.transform(F.filter(placed, lambda p: kept(p["x"])), lambda p: around(p["x"], p["i"]))


def separated_number(text: Column) -> Column:
    """6286 of `6,286`, `6 286` or `6286`; of several dots the last one is the decimal point."""
    return F.regexp_replace(F.regexp_replace(text, r"[,\s]", ""), r"\.(?=.*\.)", "").try_cast("double")


def _area_on(line: Column) -> Column:
    found = lambda pattern: separated_number(F.regexp_extract(line, pattern, 1))
    return F.coalesce(found(IN_M2), found(IN_FT2) * FT2, found(AFTER_FT2) * FT2)


def declared_area(text: Column) -> Column:
    """The built-up area in m² that a text declares: on the line of the label, else on the first of three after it; null if labels give different areas."""
    lines = F.split(F.coalesce(text, F.lit("")), r"\r?\n")
    near = lambda x, i: F.when(x.rlike(AREA_LABEL), F.get(F.array_compact(F.transform(F.slice(lines, i + 1, F.lit(4)), _area_on)), F.lit(0)))
    areas = F.array_distinct(F.transform(F.array_compact(F.transform(lines, near)), lambda a: F.floor(a * 100 + 0.5) / 100))
    return F.when(F.size(areas) == 1, F.get(areas, F.lit(0)))
