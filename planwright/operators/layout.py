"""Words at places on pages put together: lines, tokens, stacked names, and the area next to each name.

Each step reads its rows in order and keeps only what can still change: the words of lines that a later word may join, and
the names and areas of one page. So pages stream through tasks, and the result does not depend on how they are dealt. Words
move once, to the task of their page; the rest is done where they lie.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from itertools import groupby, repeat

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# What areas and names look like, and capitals that are no names of rooms.
AREA = re.compile(r"^\d{1,3}\.\d{2}$")
SQUARE_METRES = re.compile(r"^m(²|2)$")
AREA_WITH_UNIT = re.compile(r"^(\d{1,3}\.\d{2})\s+m(²|2)$")
NAME = re.compile(r"^[A-Z][A-Z'\-/0-9 ]+$")
SCHEDULE_TAG = re.compile(r"^(D|CW|W|A|S|M|E|P|I|ID)\d{2,3}")
ROOM_CODE = re.compile(r"^(GF|FF|L\d|B\d|RF|M)-\d{1,3}")
FRAME_WORDS = (
    "SCALE DRAWING TITLE PROJECT DRAWN CHECKED APPROVED REVISION FFL SHJ LM PROPOSED VILLA BOUNDARY PLOT MUNICIPALITY CONSECUTIVE ORIGINAL SHEET SIZE DATE ZONE LEAD ARCHITECT OWNER CONTRACTOR TYPICAL "
    "DETAIL DETAILS SECTION ELEVATION GROUND FIRST LOWER UPPER LEFT RIGHT FRONT REAR LEVEL NORTH SOUTH EAST WEST").split()
FRAME = re.compile(r"^(" + "|".join(FRAME_WORDS) + r")\b")
MOST_AREA, LEAST_RADIUS, RADIUS_HEIGHTS = 500.0, 60.0, 12.0

BOX = ["x_min", "y_min", "x_max", "y_max"]
_BOX = "x_min double, y_min double, x_max double, y_max double"
PAIRS = f"page bigint, name string, area_m2 double, distance double, {_BOX}"


def is_name(text: str) -> bool:
    t = text.strip()
    if re.match(r"^\d{1,2}$", t):
        return True
    return len(t) >= 3 and bool(NAME.match(t)) and not SCHEDULE_TAG.match(re.sub(r"\s", "", t)) and not ROOM_CODE.match(t) and not FRAME.match(t)


def _values(column: pa.Array) -> list:
    """A column's values. Texts, and numbers without nulls, go by way of numpy, which is many times faster than one by one."""
    bulk = pa.types.is_string(column.type) or pa.types.is_primitive(column.type) and not column.null_count
    return column.to_numpy(zero_copy_only=False).tolist() if bulk else column.to_pylist()


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        yield from map(dict, map(zip, repeat(batch.schema.names), zip(*map(_values, batch.columns))))


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(page, text, x_min, y_min, x_max, y_max) of each row."""
    for batch in batches:
        yield from zip(*map(_values, batch.columns))


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 4096) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield _batch(held, schema)
            held = []
    yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else repeat(()), schema)], schema=schema)


_ARROW = {"bigint": pa.int64(), "double": pa.float64(), "string": pa.string()}


def _streamed(df: DataFrame, fold: Callable[[Iterator], Iterator[tuple]], schema: str, rows: Callable[[Iterator[pa.RecordBatch]], Iterator] = _words) -> DataFrame:
    arrow = pa.schema([(c.split()[0], _ARROW[c.split()[1]]) for c in schema.split(", ")])
    return df.mapInArrow(lambda batches: _batches(fold(rows(batches)), arrow), schema)


def _lined(words: Iterator[tuple]) -> Iterator[tuple]:
    """(word, its line, lines that no later word can join) of each word in order; at last None with the lines that are left.

    A line is a list: its number on the page, the middle and height, how many words joined it, and a list for the reader's use.
    """
    page, lines, made = object(), [], 0
    for w in words:  # comparisons and no calls of min() and the like: this runs for each word of all pages
        passed = []
        if w[0] != page:
            page, passed, lines, made = w[0], lines, [], 0
        height, middle = w[5] - w[3], (w[3] + w[5]) / 2
        if not height > 1.0:
            height = 1.0
        # A line more than half its height above can take no later word either.
        kept, line = [], None
        for x in lines:
            above = middle - x[1]
            if above < 0.5 * x[2]:
                kept.append(x)
                near = 0.5 * (height if height < x[2] else x[2])
                if line is None and -near < above < near:
                    line = x
            else:
                passed.append(x)
        lines = kept
        if line is None:
            line = [made, middle, height, 1, []]
            lines.append(line)
            made += 1
        else:
            line[3] += 1
            line[1] = (line[1] * (line[3] - 1) + middle) / line[3]
            if height > line[2]:
                line[2] = height
        yield w, line, passed
    yield None, None, lines


def _line_fold(words: Iterator[tuple]) -> Iterator[tuple]:
    for w, line, _ in _lined(words):
        if w is not None:
            yield (w[0], line[0], line[3], *w[1:])


def _in_order(words: DataFrame, dealt: bool) -> DataFrame:
    whole = words.where(F.col("page").isNotNull() & F.col("text").isNotNull() & ~F.isnull(F.col("x_min") + F.col("y_min") + F.col("x_max") + F.col("y_max")))
    middle = ((F.col("y_min") + F.col("y_max")) / 2).alias("middle")
    rows = whole.select(F.col("page").cast("bigint"), "word_no", "text", *[F.col(c).cast("double") for c in BOX], middle)
    return (rows if dealt else rows.repartition("page")).sortWithinPartitions("page", "middle", "word_no", "text", *BOX).select("page", "text", *BOX)


def lines(words: DataFrame, dealt: bool = False) -> DataFrame:
    """`words` (page, word_no, text and box) with line and place: words within half a text height of a line's running mean join it.

    Words come in order of their middle, then of word_no, and join the first line made that fits. Words without a page,
    a text or a whole box are left out; repeated rows are words of their own. `dealt` says that the words of a page are in
    one task already, here and below; else they are brought there.
    """
    return _streamed(_in_order(words, dealt), _line_fold, f"page bigint, line bigint, place bigint, text string, {_BOX}")


TOKENS = f"page bigint, line bigint, token bigint, text string, {_BOX}, height double"


def _joined(words: list[tuple]) -> list[dict]:
    """Tokens of a line's words, from the left."""
    out, token = [], None
    for _, text, x_min, y_min, x_max, y_max in sorted(words, key=lambda w: (w[2] != w[2], w[2])) if len(words) > 1 else words:
        own = y_max - y_min
        if not own > 1.0:
            own = 1.0
        if token is not None and x_min - token["x_max"] <= token["height"]:
            token["text"], token["x_max"], token["height"] = f"{token['text']} {text}".strip(), x_max, max(token["height"], own)
            token["y_min"], token["y_max"] = min(token["y_min"], y_min), max(token["y_max"], y_max)
        else:
            token = {"text": text, "x_min": x_min, "y_min": y_min, "x_max": x_max, "y_max": y_max, "height": own}
            out.append(token)
    return out


def _lines_of_tokens(words: Iterator[tuple]) -> Iterator[tuple]:
    """(page, line, tokens) of each line, as soon as no later word can join it; those of a page come together."""
    for w, line, passed in _lined(words):
        for x in passed:
            yield x[4][0][0], x[0], _joined(x[4])
        if w is not None:
            line[4].append(w)


def _numbered(lines: Iterator[tuple]) -> Iterator[tuple]:
    for page, line, made in lines:
        for n, t in enumerate(made):
            yield (page, line, n, *t.values())


def _token_fold(rows: Iterator[dict]) -> Iterator[tuple]:
    of_line = groupby(rows, lambda w: (w["page"], w["line"]))
    return _numbered((page, line, _joined([(page, w["text"], *[w[c] for c in BOX]) for w in ws])) for (page, line), ws in of_line)


def tokens(lined: DataFrame) -> DataFrame:
    """Neighbouring words of a line, at most a text height apart, as one token: (page, line, token, text, box, height)."""
    ordered = lined.repartition("page", "line").sortWithinPartitions("page", "line", "x_min", "place")
    return _streamed(ordered.select("page", "line", "text", *BOX), _token_fold, TOKENS, _rows)


def page_tokens(words: DataFrame, dealt: bool = False) -> DataFrame:
    """tokens(lines(words)) in one pass: a line's tokens are made where its words were put together."""
    return _streamed(_in_order(words, dealt), lambda ws: _numbered(_lines_of_tokens(ws)), TOKENS)


def stacked(blocks: list[dict]) -> list[dict]:
    """Name tokens of a page, those under each other in one column joined; a block takes what follows it from the top down."""
    blocks = sorted(blocks, key=lambda b: (b["y_min"], b["x_min"]))
    out, gone, n = [], [False] * len(blocks), len(blocks)
    tops, lefts, rights = ([b[c] for b in blocks] for c in ("y_min", "x_min", "x_max"))
    for i, a in enumerate(blocks):
        if gone[i]:
            continue
        left, right, bottom, height = lefts[i], rights[i], a["y_max"], a["height"]
        for j in range(i + 1, n):
            gap = tops[j] - bottom
            if gap >= 2.5 * height:
                break  # all that follow begin lower still
            if (rights[j] if rights[j] < right else right) - (lefts[j] if lefts[j] > left else left) > -height and not gone[j] and gap >= -0.6 * height:
                b = blocks[j]
                a["text"], a["y_min"] = f"{a['text']} {b['text']}".strip(), min(a["y_min"], b["y_min"])
                left, right, bottom, height = min(left, b["x_min"]), max(right, b["x_max"]), max(bottom, b["y_max"]), max(height, b["height"])
                gone[j] = True
        a["x_min"], a["x_max"], a["y_max"], a["height"] = left, right, bottom, height
        out.append(a)
    return out


def areas(page: list[dict]) -> list[dict]:
    """Areas in m² among a page's tokens, in their order: a number with its unit, or followed by it."""
    out = []
    for k, t in enumerate(page):
        if not t["text"][:1].isdigit():
            continue
        both = AREA_WITH_UNIT.match(t["text"])
        unit = page[k + 1] if not both and k + 1 < len(page) and AREA.match(t["text"]) and SQUARE_METRES.match(page[k + 1]["text"].strip()) else None
        if not both and unit is None:
            continue
        value = float(both[1] if both else t["text"])
        if 0 < value < MOST_AREA:
            out.append(t | {"area": value} | ({} if both else {"x_max": unit["x_max"], "y_max": max(t["y_max"], unit["y_max"])}))
    return out


def pairs(page: list[dict], known: dict[str, bool] | None = None) -> Iterator[tuple]:
    """(name, area, distance, box of the name): each area takes the nearest name within 12 text heights that is not taken yet.

    `known` keeps which texts are names from page to page. An area looks at names of about its height on the page alone.
    """
    known = {} if known is None else known
    for t in page:
        if t["text"] not in known:
            known[t["text"]] = is_name(t["text"])
    names = stacked([dict(t) for t in page if known[t["text"]]])
    centre = lambda b: ((b["x_min"] + b["x_max"]) / 2, (b["y_min"] + b["y_max"]) / 2)
    # Sorted by their height on the page; one without a number there is near nothing.
    free = sorted((y, k, x) for k, (x, y) in enumerate(map(centre, names)) if y == y)
    heights = [y for y, _, _ in free]
    taken = [False] * len(names)
    for area in areas(page):
        x, y = centre(area)
        radius, best = max(LEAST_RADIUS, RADIUS_HEIGHTS * area["height"]), None
        # A little more than the radius, as the differences below are rounded.
        reach = radius + 1e-9 * (radius + abs(y))
        for ny, k, nx in free[bisect_left(heights, y - reach) : bisect_right(heights, y + reach)]:
            across = x - nx
            if -radius <= across <= radius and not taken[k] and abs(y - ny) <= radius:
                far = (across * across + (y - ny) * (y - ny)) ** 0.5
                if far <= radius and (best is None or (far, k) < best):
                    best = (far, k)
        if best:
            taken[best[1]] = True
            n = names[best[1]]
            yield (n["text"].strip(), area["area"], best[0], *[n[c] for c in BOX])


#: Texts of which a task keeps whether they are names.
_KNOWN = 100_000


def _page_fold(words: Iterator[tuple]) -> Iterator[tuple]:
    known: dict[str, bool] = {}
    for page, lines in groupby(_lines_of_tokens(words), lambda x: x[0]):
        held = [t for _, _, made in sorted(lines, key=lambda x: x[1]) for t in made]
        if len(known) > _KNOWN:
            known.clear()
        yield from ((page, *p) for p in pairs(held, known))


def room_areas(words: DataFrame, dealt: bool = False) -> DataFrame:
    """(page, name, area_m2, distance, box of the name) of all pages of words. Only a page's tokens are held together, as a page is one drawing; an empty table gives no rows."""
    return _streamed(_in_order(words, dealt), _page_fold, PAIRS)
