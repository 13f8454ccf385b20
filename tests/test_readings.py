"""Rooms, schedules, labels and texts that are read twice or from drawings: given cases, nulls, ties, empty tables."""

import random

from pyspark.sql import functions as F

from planwright.functions import sheets, strings
from planwright.operators import classify, edits, reconcile, rooms, spatial


def one(spark, column, text):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t")).alias("x")).head()["x"]


def test_schedule_rows(spark):
    door = lambda t: tuple(one(spark, lambda c: sheets.schedule_row(c, F.lit("D01"), "DOOR"), t))
    window = lambda t: tuple(one(spark, lambda c: sheets.schedule_row(c, F.lit("CW01"), "WINDOW"), t))
    assert door("  D01    6    1.00    3.00    3.00    D01 1000 X 3000") == (6, 1000, 3000)
    assert door("  D01 D02 D03 D04") == (None, None, None) and door("no tag") == (None, None, None)
    assert window("  CW01    3.03    4.04    1    Sliding Windows    GROUND FLOOR") == (1, 3030, 4040)
    assert window("  CW01            CW15") == (None, None, None)


def test_texts(spark):
    assert one(spark, sheets.declared_area, "TOTAL BUILT-UP AREA SQ.FT 6,286") == 583.99
    assert one(spark, sheets.declared_area, "BUA: 584 m²\nBUA = 600 sqm") is None and one(spark, sheets.declared_area, None) is None
    assert tuple(one(spark, sheets.room_label, "GF-04 58.82 m²")) == ("code-area", "GF-04", 58.82, None)
    assert one(spark, sheets.scale_denominator, "1 to 75") is None and one(spark, sheets.scale_denominator, "A1 1/100") == 100
    assert one(spark, strings.plain_mtext, r"{\fArial|b0;GF-04\P58.82 m²}") == "GF-04 58.82 m²"
    found = one(spark, lambda c: sheets.neighbours(F.split(c, "\n")), "a\n \n\nb\n\n\n\n\nc")
    assert [(r.previous, r.next) for r in found][:4] == [(None, "b"), ("a", "b"), ("a", "b"), ("a", None)]


def test_rooms(spark):
    schema = "p int, name string, place int, area double, finish_code string"
    vision = spark.createDataFrame([(1, "HALL", 1, 10.0, None), (1, "HALL", 2, 20.0, "ST01"), (1, None, 3, 5.0, None)], schema)
    text = spark.createDataFrame([(1, "HALL", 1, 20.3, "PR01"), (1, "BATH", 2, None, None), (1, None, 3, 9.0, None)], schema)
    out = {r.name: (r.area, r.finish_code, r.basis, r.confidence, r.mismatch) for r in rooms.reconcile_rooms(vision, text, ["p"]).collect()}
    assert out == {"HALL": (20.0, "ST01", "MEASURED", 90, False), "BATH": (None, None, "PARAMETRIC", 50, False), None: (5.0, None, "MEASURED", 60, True)}
    assert rooms.reconcile_rooms(vision.limit(0), text.limit(0), ["p"]).isEmpty()
    merged = rooms.merge_spatial(vision, text.where("name IS NOT NULL").withColumn("name", F.concat(F.lit(" "), F.lower("name"))), ["p"])
    assert {r.room: (r.area, r.source) for r in merged.collect()} == {"HALL": (20.3, "both"), "BATH": (None, "label"), None: (5.0, "text")}


def test_schedules_of_both_readings(spark):
    schema = "tag string, n int, width_mm double, height_mm double, finish_code string"
    seen = spark.createDataFrame([("a", 60, 900.0, 2100.0, None), ("b", 70, 1.0, 1.0, "x"), ("c", 2, 900.0, None, "x"), ("e", 1, 900.0, 1.0, None)], schema)
    read = spark.createDataFrame([("a", 4, 900.0, 2100.0, None), ("c", 2, 900.00001, None, ""), ("d", 80, None, None, None), ("e", 1, 905.0, 1.0, None)], schema)
    out = {r.tag: (r.n, r.basis, r.confidence, r.mismatch) for r in reconcile.reconcile_schedules(seen, read, ["tag"]).collect()}
    assert out == {"a": (4, "MEASURED", 60, "count"), "b": (70, "VISUAL", 70, None), "e": (1, "MEASURED", 60, "width_mm"), "c": (2, "MEASURED", 60, "finish"), "d": (80, "PARAMETRIC", 50, None)}


def test_pairs_are_those_of_one_by_one_choice(spark):
    rng = random.Random(5)
    made = [(rng.randrange(2), i, float(rng.randrange(60)), float(rng.randrange(60))) for i in range(120)]
    areas, names = [p for p in made if p[1] % 3 == 0], [p for p in made if p[1] % 3]
    want, used = set(), set()
    for page, i, x, y in areas:
        free = [((x - a) ** 2 + (y - b) ** 2, k) for q, k, a, b in names if q == page and k not in used and (x - a) ** 2 + (y - b) ** 2 <= 15**2]
        if free:
            used.add(min(free)[1])
            want.add((page, i, min(free)[1]))
    schema = "page int, point_id int, x double, y double"
    got = spatial.one_to_one(spark.createDataFrame(areas, schema), spark.createDataFrame(names, schema), 15.0)
    assert {(r.page, r.point_id, r.label_id) for r in got.collect()} == want and len(want) > 20
    assert spatial.one_to_one(spark.createDataFrame([], schema), spark.createDataFrame(names, schema), 15.0).isEmpty()


def test_line_classes(spark):
    schema = "id int, category string, status string, qty double, rate_code string, rate_hint string, floor_code string, ceiling_code string"
    lines = spark.createDataFrame([(1, "SKIRTING", "AI", 2.0, None, None, "PR01", None), (2, "CEILING", "AI", 2.0, None, None, None, "CL02"), (3, "OTHER", "AI", None, None, None, None, None),
                                   (4, "OTHER", "EDITED", 0.0, None, None, None, None), (5, "PAINT", "AI", 1.0, None, None, None, None), (6, "PAINT", "AI", 1.0, "P-1", None, None, None)], schema)
    rates = spark.createDataFrame([("SKIRTING-LM", 5.0), ("P-1", 0.0)], "code string, rate double")
    out = {r.id: (r.state, r.is_priced, r.warning, r.matched_code, r.suggested_code) for r in classify.classify_lines(lines, rates, spark.createDataFrame([("PAINT",)], "category string")).collect()}
    assert out == {1: ("ACTIVE", True, None, "SKIRTING-LM", None), 2: ("ACTIVE", False, "RATE_SLOT_MISSING", None, "CL-CL02"), 3: ("SUPPRESSED", False, None, None, None),
                   4: ("ACTIVE", True, None, None, None), 5: ("ACTIVE", True, None, None, None), 6: ("ACTIVE", False, "RATE_MISSING", "P-1", "P-1")}


def test_rates_follow_the_seed(spark):
    old, seed = spark.createDataFrame([("a",), ("b",), ("b",)], "code string"), spark.createDataFrame([("b", 2), ("c", 3)], "code string, rate int")
    assert {r.code: r.action for r in edits.sync_by_key(old, seed, ["code"]).collect()} == {"a": "deleted", "b": "updated", "c": "inserted"}
