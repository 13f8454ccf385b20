"""Rate codes of lines by category and tag, vanity proposals, and classes of room names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Codes of a category and tag, of a category and the beginning of a tag, and of a category alone.
BY_TAG = {
    "FLOOR_FINISH": {"FF-ST01": "FLR-ST01", "FF-PR01": "FLR-PR01", "FF-PR03": "FLR-PR03", "FF-BATHROOM": "FLR-BATH", "FF-ST03": "EXT-ST03", "FF-ST02": "STAIR-LAND"},
    "WALL_FINISH": {"WF-PAINT": "PAINT-INT", "WF-WD01": "WALL-WOODPORC", "WF-WD02": "WALL-MARBPORC"},
    "CEILING": {"CL-CL02": "CEIL-CL02", "CL-CL03": "CEIL-CL03", "CL-CL01-EXT": "CEIL-CL01-EXT"},
    "OTHER": {"STAIR-TREAD": "STAIR-TREAD", "THRESH": "THRESH", "HANDRAIL-MDF": "HANDRAIL-MDF"},
}
BY_PREFIX = {"JOINERY": {"VAN-": "VANITY", "KB-": "KIT-BASE", "KW-": "KIT-WALL"}}
BY_CATEGORY = {"PAINT": "PAINT-INT", "SCREED": "SCREED-FLR", "SKIRTING": "SKIRT-PR01"}
#: Sizes that a door's description names, the first that fits; others have the last code.
DOORS = [("1000", "3000", "DOOR-1000x3000-FN01"), ("900", "2400", "DOOR-900x2400")]
DOOR_OTHER = "DOOR-STD-LACQ"
#: Words of room names.
BATHROOM = r"(?i)\b(BATH|TOILET|POWDER|WC|LAVATORY|RESTROOM)\b"
STAIRCASE = r"(?i)\bSTAIR(CASE)?\b"
NO_FINISH = r"(?i)\b(GARAGE|PROJECTION|VOID|SHAFT|MEP\b|PEDESTRIAN|VEHICULAR|GATE|COVERED\s*GATE|^UP\s*\(?STAIR\b|UP\s*\(STAIR\))"
NO_ROOM = r"(?i)\b(SKYLIGHT|VOID|ABOVE|OVER|UNDER)\b"


def _lookup(values: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in values.items() for x in pair]), key)


def rate_code(category: Column, tag: Column, description: Column, unit: Column) -> Column:
    """The code under which the rate library has a line; null means that it stays provisional."""
    upper = F.upper(F.coalesce(tag, F.lit("")))
    exact = _lookup({f"{c}|{t}": code for c, tags in BY_TAG.items() for t, code in tags.items()}, F.concat_ws("|", category, upper))
    begins = [F.when((category == c) & upper.startswith(p), code) for c, tags in BY_PREFIX.items() for p, code in tags.items()]
    names = lambda size: F.coalesce(description, F.lit("")).contains(size)
    sized = [F.when(names(w) & names(h), code) for w, h, code in DOORS]
    door = F.when(category == "DOOR", F.coalesce(*sized, F.lit(DOOR_OTHER)))
    outside = F.when((category == "EXTERNAL") & (unit == "m²"), "EXT-ST03")
    return F.coalesce(exact, *begins, door, outside, _lookup(BY_CATEGORY, category))


def vanity(name: Column, finish: Column) -> Column:
    """The confidence that a room has one vanity: 95 if name and finish say bathroom, 80 if one does, else null."""
    by_name, by_finish = F.coalesce(name.rlike(BATHROOM), F.lit(False)), F.coalesce(finish == "BATHROOM", F.lit(False))
    sure = F.when(by_name & by_finish, 95).when(by_name | by_finish, 80)
    return F.when(~F.coalesce(name.rlike(NO_ROOM), F.lit(False)), sure)


def is_placeholder(source: Column, evidence: Column) -> Column:
    """Whether the source or any of the evidence texts calls the rate a placeholder."""
    says = lambda x: F.coalesce(F.lower(x).contains("placeholder"), F.lit(False))
    return says(source) | F.exists(evidence, says)


def duration_text(ms: Column) -> Column:
    """950 ms, 12s or 3m07s; a dash for what has not begun."""
    s = F.floor(ms / 1000)
    minutes = F.concat(F.floor(s / 60).cast("string"), F.lit("m"), F.lpad((s % 60).cast("string"), 2, "0"), F.lit("s"))
    text = F.when(ms < 1000, F.concat(ms.cast("string"), F.lit(" ms"))).when(s < 60, F.concat(s.cast("string"), F.lit("s"))).otherwise(minutes)
    return F.coalesce(F.when(ms.isNotNull(), text), F.lit("—"))
