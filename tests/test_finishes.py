"""Colours of rooms: given cases, every rung of the ladder, nulls, ties, repeats and empty tables; spaces from templates."""

from pyspark.sql import functions as F

from planwright.operators import finish_map, templates

BLUE, GREEN, BLACK, WHITE = (130, 170, 220), (140, 200, 130), (0, 0, 0), (255, 255, 255)
LEGEND = "drawing string, place int, code string, swatch array<struct<r:int,g:int,b:int>>"
ROOMS = "drawing string, room int, name string, pixels array<struct<r:int,g:int,b:int>>"


def test_palettes(spark):
    rows = [("a", 0, "ST01", None), ("a", 1, "pr03", [WHITE] * 9), ("a", 2, "ZZ01", [(10, 200, 10)] * 9), ("a", 3, "ZZ02", None), ("a", 4, "ST02", [WHITE] * 8 + [GREEN] * 2), ("a", 5, "ST03", [WHITE] * 7 + [(99, 88, 190)] * 3),
            ("a", 6, "st01", [(1, 250, 1)] * 4), ("b", 0, "ZZ02", None), ("b", 1, None, [BLUE] * 4), (None, 3, "LS01", []), (None, 2, "ST01", None)]
    out = {r.drawing: [tuple(e) for e in r.palette] for r in finish_map.palettes(spark.createDataFrame(rows, LEGEND).withColumn("palette", F.lit("clash"))).collect()}
    assert out["a"] == [(0, "ST01", *BLUE, False), (1, "PR03", 170, 130, 90, False), (2, "ZZ01", 10, 200, 10, True), (4, "ST02", *GREEN, False), (5, "ST03", 99, 88, 190, True)]
    assert out["b"] == [] and out[None] == [(2, "ST01", *BLUE, False), (3, "LS01", 170, 170, 90, False)]
    assert finish_map.palettes(spark.createDataFrame([], LEGEND)).collect() == []


def test_ladder(spark):
    palette = finish_map.palettes(spark.createDataFrame([("a", 0, "ST01", None), ("a", 1, "ST02", None), ("a", 2, "TIE1", [(100, 100, 180)] * 5), ("a", 3, "TIE2", [(100, 100, 180)] * 5), ("b", 0, "ST01", None)], LEGEND))
    hatch = lambda colour: [colour] * 5 + [BLACK] * 5
    cases = [
        ("a", "LIVING", [BLUE] * 9, ("ST01", 90, "sampled", *BLUE)), ("a", "EMPTY", [WHITE] * 9, (None, 0, "no-color", None, None, None)), ("a", "NONE", None, (None, 0, "no-color", None, None, None)),
        ("a", "GARAGE — GF", [BLUE] * 9, (None, 0, "no-color", None, None, None)), ("a", "MEP SHAFT", None, (None, 0, "no-color", None, None, None)), ("a", "UP (Stair)", [BLUE], (None, 0, "no-color", None, None, None)),
        ("a", "COVERED GATE", [BLUE], (None, 0, "no-color", None, None, None)), ("a", "Pedestrian entrance", [BLUE], (None, 0, "no-color", None, None, None)),
        ("a", "Staircase", hatch(BLUE), ("ST02", 85, "sampled", None, None, None)), ("b", "STAIR 1", [BLUE] * 9, ("ST01", 90, "sampled", *BLUE)),
        ("a", "BATH 01", hatch(BLUE), ("BATHROOM", 85, "hatched-bathroom", *BLUE)), ("a", "Powder", [BLUE] * 9, ("BATHROOM", 80, "hatched-bathroom", *BLUE)), ("a", "BATHROOM", [BLUE] * 9, ("ST01", 90, "sampled", *BLUE)),
        ("a", "LAUNDRY", hatch(BLUE), ("ST01", 65, "sampled", *BLUE)), ("a", "LAUNDRY", hatch((255, 20, 20)), (None, 0, "far-from-palette", 255, 20, 20)),
        ("a", "HALL", [(255, 20, 20)] * 9, ("TIE1", 20, "far-from-palette", 255, 20, 20)), ("a", "HALL", [(100, 100, 180)] * 3, ("TIE1", 90, "sampled", 100, 100, 180)), ("a", None, [(130, 120, 220)] * 3, ("ST01", 84, "sampled", 130, 120, 220)),
        ("c", "HALL", [BLUE] * 3, (None, 0, "no-color", *BLUE)), (None, "HALL", [], (None, 0, "no-color", None, None, None)),
    ]
    rooms = spark.createDataFrame([(d, k, n, p) for k, (d, n, p, _) in enumerate(cases)], ROOMS)
    # A patch of (130, 120, 220) is 2500 from ST01 and 2900 from the ties.
    got = {r.room: tuple(r)[2:] for r in finish_map.room_finishes(rooms.withColumn("palette", F.lit(1)), palette).collect()}
    assert got == {k: want for k, (*_, want) in enumerate(cases)}
    assert finish_map.room_finishes(rooms.unionByName(rooms), palette).count() == 2 * len(cases)
    assert finish_map.room_finishes(rooms.limit(0), palette).collect() == [] and finish_map.room_finishes(rooms, palette.limit(0)).where("finish_code = 'BATHROOM'").count() == 2


def test_templates(spark):
    rows = [("office",), ("Office",), (None,), ("office",), ("retail",)]
    out = templates.from_templates(spark.createDataFrame(rows, "template_id string").withColumn("length_m", F.lit(-1))).collect()
    assert sorted((r.template_id or "", r.length_m, r.wall_category, r.subtitle_key) for r in out if r.length_m) == [("office", 4.2, "paint", "office.subtitle")] * 2 + [("retail", 8.0, "cladding", "retail.subtitle")]
    assert len(out) == 5 and templates.from_templates(spark.createDataFrame([], "template_id string")).collect() == []
