"""Finishes of rooms by the colours of a drawing: a palette from the legend's swatches, then a ladder of rules for every room."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planwright.functions.colours import hatched, modal_colour

# Colours that codes have where the drawing shows no swatch, names of rooms, and limits of coverage and of squared distance.
CANONICAL = {"ST01": (130, 170, 220), "ST02": (140, 200, 130), "ST03": (240, 180, 160), "PR01": (190, 140, 200), "PR03": (170, 130, 90), "LS01": (170, 170, 90)}
BATHROOM = r"(?i)\b(BATH|TOILET|POWDER|WC|LAVATORY|RESTROOM)\b"
STAIRS = r"(?i)\bSTAIR(CASE)?\b"
NO_FINISH = r"(?i)\b(GARAGE|PROJECTION|VOID|SHAFT|MEP\b|PEDESTRIAN|VEHICULAR|GATE|COVERED\s*GATE|^UP\s*\(?STAIR\b|UP\s*\(STAIR\))"
STAIR_CODE, BATH_CODE = "ST02", "BATHROOM"
SWATCH_COVERAGE, ROOM_COVERAGE = 0.2, 0.05
ACCEPTED, ACCEPTED_HATCHED, FAR = 12500, 12000, 25000

_COLOUR = "struct<r:int,g:int,b:int,coverage:double>"
_ENTRY = "array<struct<place:int,code:string,r:int,g:int,b:int,from_document:boolean>>"


def palettes(legends: DataFrame) -> DataFrame:
    """(drawing, palette): the colours of each drawing's legend codes, in the legend's order.

    `legends` has drawing, place, code and swatch, the pixels beside the code (null where the code does not stand on the
    drawing). A swatch of which more than a fifth is filled gives the colour, else the canonical colour of the code does;
    a code with neither is left out. Defined results: codes are compared in upper case, and the first place of a repeated
    one counts; null codes are left out; a drawing whose codes all are has an empty palette; null drawings are one.
    """
    swatch = F.coalesce(modal_colour(F.col("swatch")), F.lit(None).cast(_COLOUR))
    found = legends.select("drawing", F.col("place").cast("int").alias("place"), F.upper("code").alias("code"), swatch.alias("m"))
    once = found.groupBy("drawing", "code").agg(F.min("place").alias("place"), F.min_by("m", "place").alias("m"))
    canon = F.element_at(F.create_map(*[x for code, (r, g, b) in CANONICAL.items() for x in (F.lit(code), F.struct(F.lit(r).alias("r"), F.lit(g).alias("g"), F.lit(b).alias("b")))]), F.coalesce("code", F.lit("")))
    seen = F.coalesce(F.col("m.coverage") > SWATCH_COVERAGE, F.lit(False))
    channel = lambda c: F.when(seen, F.col(f"m.{c}")).otherwise(canon[c]).alias(c)
    entry = F.when(F.col("code").isNotNull() & (seen | canon.isNotNull()), F.struct("place", "code", channel("r"), channel("g"), channel("b"), seen.alias("from_document")))
    return once.groupBy("drawing").agg(F.array_sort(F.collect_list(entry)).cast(_ENTRY).alias("palette"))


def nearest(colour: Column, palette: Column) -> Column:
    """struct(d2, place, code) of the palette's entry with the least squared distance, the earlier of equal ones; null without a colour or an entry."""
    square = lambda e, c: (e[c] - colour[c]) * (e[c] - colour[c])
    return F.when(colour.isNotNull(), F.array_min(F.transform(palette, lambda e: F.struct((square(e, "r") + square(e, "g") + square(e, "b")).alias("d2"), e["place"].alias("place"), e["code"].alias("code")))))


def room_finishes(rooms: DataFrame, palette: DataFrame, key: str = "room") -> DataFrame:
    """(drawing, `key`, finish_code, confidence, reason, r, g, b) of every row of `rooms`.

    `rooms` has drawing, `key`, name and pixels, the patch below the room's label; `palette` is what palettes() gives: one
    row a drawing with as many entries as its legend, so the join moves no pixels where that side is small. Rungs, the
    first that holds: names that never have a finish; stairs, if the legend has their code; hatched patches (a bath by
    name, else a colour near enough, else none); baths by name; too little colour; no palette; the nearest colour, with
    little confidence if it is far. r, g and b are the sampled colour where a rung looked at it. Defined results: a null name
    is no bath and no stairs; null or empty pixels have no colour; null drawings are one; repeated rows each give a row.
    """
    known = palette.select(F.col("drawing").alias("_drawing"), "palette")
    # A number of the row keeps the sampled colour a column that later conditions do not work out again.
    sampled = rooms.select("drawing", key, "name", modal_colour(F.col("pixels")).alias("m"), hatched(F.col("pixels")).alias("hatched"), F.monotonically_increasing_id().alias("_row")).where(F.col("_row") >= 0)
    both = sampled.join(known, F.col("drawing").eqNullSafe(F.col("_drawing")), "left")
    both = both.withColumn("n", nearest(F.col("m"), F.coalesce("palette", F.array().cast(_ENTRY))))
    named = lambda pattern: F.coalesce(F.col("name").rlike(pattern), F.lit(False))
    covered = F.coalesce(F.col("m.coverage"), F.lit(0.0))
    d2 = F.col("n.d2")
    sure = F.floor(F.greatest(F.lit(30.0), 90 - d2 / ACCEPTED * 30) + 0.5).cast("int")
    rung = lambda code, confidence, reason, colour=True: F.struct(
        (code if isinstance(code, Column) else F.lit(code).cast("string")).alias("finish_code"), (confidence if isinstance(confidence, Column) else F.lit(confidence)).alias("confidence"),
        F.lit(reason).alias("reason"), *[(F.col(f"m.{c}") if colour else F.lit(None).cast("int")).alias(c) for c in "rgb"])
    stair = F.exists(F.coalesce("palette", F.array().cast(_ENTRY)), lambda e: e["code"] == STAIR_CODE)
    near_enough = F.coalesce((covered > ROOM_COVERAGE) & (d2 < ACCEPTED_HATCHED), F.lit(False))
    found = (
        F.when(named(NO_FINISH), rung(None, 0, "no-color", False))
        .when(named(STAIRS) & stair, rung(STAIR_CODE, 85, "sampled", False))
        .when(F.col("hatched") & named(BATHROOM), rung(BATH_CODE, 85, "hatched-bathroom"))
        .when(F.col("hatched") & near_enough, rung(F.col("n.code"), 65, "sampled"))
        .when(F.col("hatched"), rung(None, 0, "far-from-palette"))
        .when(named(BATHROOM), rung(BATH_CODE, 80, "hatched-bathroom"))
        .when((covered < ROOM_COVERAGE) | d2.isNull(), rung(None, 0, "no-color"))
        .when(d2 > FAR, rung(F.col("n.code"), 20, "far-from-palette"))
        .otherwise(rung(F.col("n.code"), sure, "sampled"))
    )
    return both.select("drawing", key, found.alias("f")).select("drawing", key, "f.*")


def _pixels(points: Column, dpi: Column) -> Column:
    return F.floor(points * dpi / 72 + 0.5)


def _window(x0: Column, x1: Column, y0: Column, y1: Column) -> Column:
    return F.struct(*[v.cast("bigint").alias(k) for k, v in (("x0", x0), ("x1", x1), ("y0", y0), ("y1", y1))])


def swatch_window(box: Column, dpi: Column) -> Column:
    """struct(x0, x1, y0, y1) in pixels: the patch left of a legend code at `box` (x_min, y_min, x_max, y_max in points)."""
    wide, high, left = _pixels(box["x_max"] - box["x_min"], dpi), _pixels(box["y_max"] - box["y_min"], dpi), _pixels(box["x_min"], dpi)
    gap, edge = F.floor(high * 0.5 + 0.5), F.floor(high * 0.3 + 0.5)
    return _window(left - F.greatest(wide, high * 2) - gap, left - gap, _pixels(box["y_min"], dpi) - edge, _pixels(box["y_max"], dpi) + edge)


def room_window(box: Column, dpi: Column) -> Column:
    """struct(x0, x1, y0, y1) in pixels: the patch below a room's label at `box`, three text heights high."""
    wide, high = _pixels(box["x_max"] - box["x_min"], dpi), _pixels(box["y_max"] - box["y_min"], dpi)
    reach = F.floor(high * 1.5 + 0.5)
    middle, below, half = _pixels((box["x_min"] + box["x_max"]) / 2, dpi), _pixels(box["y_max"], dpi) + reach, F.greatest(wide, high * 3)
    return _window(middle - half, middle + half, below - reach, below + reach)
