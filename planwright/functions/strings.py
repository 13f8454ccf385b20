"""Text expressions: room names, units, floors, labels and codes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Canonical unit by synonym; fixed values.
UNITS = {
    "nr": "nr", "no": "nr", "each": "nr", "ea": "nr",
    "m²": "m²", "m2": "m²", "sqm": "m²",
    "m": "lm", "lm": "lm", "linear": "lm", "metres": "lm", "meters": "lm",
    "lumpsum": "lumpsum", "ls": "lumpsum", "lot": "lumpsum",
}
#: Floor by alias; fixed values.
FLOORS = {
    "gf": "GF", "ground floor": "GF", "g floor": "GF", "ground": "GF",
    "l1": "L1", "ff": "L1", "first floor": "L1", "f1": "L1", "level 1": "L1",
    "l2": "L2", "sf": "L2", "second floor": "L2", "f2": "L2", "level 2": "L2",
    "roof": "Roof", "rf": "Roof", "roof level": "Roof", "roof terrace": "Roof",
    "basement": "B1", "b1": "B1", "lower ground": "B1", "mezzanine": "M", "mezz": "M",
}
#: Codes that stand on a floor legend; fixed values.
FLOOR_LEGEND = ["ST01", "ST03", "PR01", "PR03", "BATHROOM"]
#: Names of area statements, not rooms; fixed values.
STATEMENTS = [
    r"\bvilla\b", r"\bplot\b", r"\bproposed\b", r"\bbua\b", r"^\s*ground\s*floor(\s|$|—)", r"^\s*first\s*floor(\s|$|—)", r"^\s*roof(\s|$|—)",
    r"\bsetting\s*out\b", r"\bplan\s*area\b", r"\bgarage\s*block\b", r"\baccessible\s*roof\b", r"\bnon[\s-]*accessible\s*roof\b", r"\bplot\s*boundary\b",
]
#: Labels that are no rooms; fixed values. The tag pattern minds the case, the others do not.
NOT_ROOMS = [
    r"^\s*drawing\s*(title|no|number|name)\b", r"^\s*sheet\s*(no|number|size|name|title)\b", r"^\s*scale\b", r"^\s*revision\b",
    r"^\s*project\s*(no|number|name|title)\b", r"^\s*(drawn|checked|approved|date|zone|reference)\s*[:=]?\s*$",
    r"^\s*(client|consultant|architect|contractor|owner|lead)\b",
    r"^\s*(door|window|glazing|finish|finishes|finish[\s-]*schedule|room[\s-]*schedule|material[\s-]*schedule)\s*(schedule|types|list)?\s*$",
    r"^\s*(legend|key\s*plan|key\s*to\s*finishes?|finish\s*key|notes?|general\s*notes?|specification\s*notes?)\s*$",
    r"^\s*list\s*of\s*(materials?|finishes?|drawings?)\b", r"^\s*area\s*(table|statement|schedule)\b",
    r"^\s*(typ|typical|details?|section|elevation)\s*[:=]?\s*$", r"^\s*(north|south|east|west)\b", r"^\s*(up|dn|down)\s*\(?\s*stair",
    r"^\s*future\s+lift\b", r"^\s*flat\s+room\b", r"^\s*high\s+level\s+window\b", r"^\s*covered\s+gate\b", r"^\s*home\s*$",
    r"^\s*(garden|garden\s+area)\s*$", r"^\s*b\.?\s*b\.?\s*q\.?\b", r"^\s*(pedestrian|vehicular|driver['’]?s)\s+entrance\b", r"\baccessway\b",
    r"\bsliding\s+door\s+future\s+lift\b", r"^\s*void\b", r"\b(stair|lift|shaft)\s*void\b", r"^\s*(roof|floor)?\s*projection\b", r"^\s*overhang\b",
    r"^\s*canopy\b", r"^\s*cantilever\b", r"^\s*planter\b", r"^\s*pergola\b", r"^\s*duct\s*(shaft|riser)?\b", r"^\s*ahu\s*(room)?\s*$",
]
NOT_ROOM_TAG = r"^\s*[A-Z]{1,3}\d{2,3}([-/][A-Z]?\d*)?\s*$"
#: Rooms without a ceiling, and wet rooms; fixed values.
NO_CEILING = r"\b(BALCONY|TERRACE|GARAGE|VOID|MAID'?S ROOM)\b"
WET_CEILING = r"\b(BATH|TOILET|POWDER|WC|LAUNDRY|KITCHEN)\b"
#: Room names that mean the same, in order; fixed values.
ROOM_NAMES = [
    (r"\bBED\s+ROOM\b", "BEDROOM"), (r"\bBATH\s+ROOM\b", "BATHROOM"), (r"\bDINN?ING\b", "DINING"), (r"\bLOBBY?S\b", "LOBBY"),
    (r"\bBATHROOM\b", "BATH"), (r"\bBOH\s+KITCHEN\b", "KITCHEN"),
]
MISREAD_KITCHEN = r"\b(?:BOW|BOX|ION|BOY)\s+KITCHEN\b"
STRUCTURAL = r"(?i)\b(STAIR|LANDING|STORE|VOID|SHAFT)\b"
FLOOR_MARKS = ["GF", "FF", "RF", "L1", "L2"]


def any_of(patterns: list[str]) -> str:
    """One pattern for all of them, whatever the case."""
    return "(?i)" + "|".join(f"(?:{p})" for p in patterns)


def lookup(values: dict[str, str], key: Column) -> Column:
    """The value for a key of a small fixed mapping, else null."""
    pairs = [F.lit(x) for kv in values.items() for x in kv]
    return F.element_at(F.create_map(*pairs), key)


def unit(u: Column) -> Column:
    cleaned = F.lower(F.trim(u))
    return F.coalesce(lookup(UNITS, cleaned), cleaned)


def floor_name(f: Column) -> Column:
    """The usual name of a floor; unknown ones stay as written, without outer white space, and blank ones are null."""
    trimmed = F.regexp_replace(f, r"^\s+|\s+$", "")
    return F.when(trimmed != "", F.coalesce(lookup(FLOORS, F.lower(trimmed)), trimmed))


def room_key(name: Column) -> Column:
    """Names of one room compare equal: words in order, without what follows a dash, floor codes, and the word ROOM; stairs, stores and voids keep their floor."""
    text = F.upper(F.split(name, "—")[0])
    text = F.regexp_replace(text, "[‘’ʼ]", "'")
    text = F.regexp_replace(text, MISREAD_KITCHEN, "BOH KITCHEN")
    text = F.regexp_replace(text, r"\b(?:GF|FF|RF|L1|L2|B1|B2|BF)[\s-]?\d{1,3}\b", "")
    text = F.trim(F.regexp_replace(F.regexp_replace(text, "[.,;:()/&-]", " "), r"\s+", " "))
    for pattern, new in ROOM_NAMES:
        text = F.regexp_replace(text, pattern, new)
    plain = F.filter(F.split(text, " "), lambda t: (t != "ROOM") & (t != "") & (name.rlike(STRUCTURAL) | ~t.isin(*FLOOR_MARKS)))
    return F.array_join(F.array_sort(plain), " ")


def is_statement(name: Column) -> Column:
    return name.rlike(any_of(STATEMENTS))


def is_not_a_room(name: Column, area: Column) -> Column:
    cleaned = F.trim(F.coalesce(name, F.lit("")))
    odd = (cleaned == "") | (F.length(cleaned) > 60) | F.coalesce((area > 0) & (area < 0.5), F.lit(False))
    return odd | cleaned.rlike(any_of(NOT_ROOMS)) | cleaned.rlike(NOT_ROOM_TAG)


def is_floor_legend_code(code: Column) -> Column:
    return code.isin(*FLOOR_LEGEND)


def ceiling_class(name: Column, finish: Column) -> Column:
    """None for open places and external paving, CL02 for wet rooms, else CL03. BATHROOM is no word BATH, so it is CL03."""
    up, none = F.upper(name), F.lit(None).cast("string")
    return F.when(up.rlike(NO_CEILING), none).when(finish == "ST03", none).when(up.rlike(WET_CEILING), "CL02").otherwise("CL03")


def services_key(name: Column) -> Column:
    """One room in services counts: letters and digits alone."""
    return F.trim(F.regexp_replace(F.upper(name), "[^A-Z0-9]+", " "))


def tag_label(text: Column) -> Column:
    """D-02 and d02 alike as D02, digits as they are written; null for other text."""
    pattern = r"^\s*([A-Za-z]{1,4})-?(\d{1,3})\s*$"
    return F.when(text.rlike(pattern), F.concat(F.upper(F.regexp_extract(text, pattern, 1)), F.regexp_extract(text, pattern, 2)))


def plain_mtext(text: Column) -> Column:
    """Drawing text without its formatting codes."""
    for pattern, new in [(r"\\pxqc[^;]*;", ""), (r"\\f[^;]*;", ""), (r"\\[A-Za-z][0-9.x-]*;", ""), (r"\\P", " "), (r"[{}]", ""), (r"^[\s,;]+", ""), (r"\s+", " ")]:
        text = F.regexp_replace(text, pattern, new)
    return F.trim(F.coalesce(text, F.lit("")))


def serial(number: Column, width: int) -> Column:
    """A number with leading zeros up to `width` digits; longer ones keep all of theirs."""
    return F.format_string(f"%0{width}d", number)


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-|-$", "")
