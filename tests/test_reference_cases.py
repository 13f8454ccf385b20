"""The given cases of rules that were wrong before: unit costs, skirting, floors, tags, serial numbers beyond their width."""

from pyspark.sql import functions as F

from planwright.functions import strings as S
from planwright.operators import filters, pricing, quantify

PAINT_SYSTEM = [  # primer, stucco, top coat, labour, tools: 0.65 + 2.75 + 10.80 + 6.00, and 0.30 of tools at 500
    (1, "MATERIAL", 6.5, 10.0, 1, 0.0, None), (1, "MATERIAL", 5.5, 2.0, 1, 0.0, None), (1, "MATERIAL", 54.0, 10.0, 2, 0.0, None), (1, "LABOR", 6.0, None, None, None, None), (1, "TOOL_FIXED", None, None, None, None, 150.0),
    (2, "MATERIAL", 100.0, 0.0, 1, 0.0, None), (3, "MATERIAL", 100.0, 10.0, 1, 20.0, None), (4, "MATERIAL", None, None, None, None, None)]
COMPONENT = "assembly_id int, kind string, unit_price double, coverage double, coats int, wastage_pct double, fixed_cost double"


def values(spark, kind, rows, column):
    return [r[0] for r in spark.createDataFrame([(x,) for x in rows], f"x {kind}").select(column(F.col("x"))).collect()]


def test_unit_costs(spark):
    parts = spark.createDataFrame(PAINT_SYSTEM, COMPONENT)
    cost = lambda qty: {r.assembly_id: round(r.unit_cost, 4) for r in pricing.unit_costs(parts, qty).collect()}
    assert cost(None) == {1: 20.2, 2: 0.0, 3: 12.0, 4: 0.0} and cost(500.0)[1] == 20.5
    assert pricing.unit_costs(parts.limit(0)).count() == 0


def test_floors_reach_the_second_tier(spark):
    lines = spark.createDataFrame([(1, 1, "SCREED", "m2", None, "R", 2.0), (2, 1, "PLASTER", "m2", None, "R", 2.0), (3, 1, "DOOR", "nr", None, None, None)], "item int, org_id int, category string, unit string, finish_code string, code string, qty double")
    assemblies = spark.createDataFrame([(2, None, "FLOOR", "sqm", None, 1), (3, None, "WALL", "m²", None, 1)], "assembly_id int, takeoff_category string, applies_to string, output_unit string, finish_code string, sort_order int")
    rates = spark.createDataFrame([], "org_id int, code string, unit string, rate double")
    out = pricing.rate_waterfall(lines, assemblies, spark.createDataFrame(PAINT_SYSTEM, COMPONENT), rates)
    assert {r.item: (r.source, r.rate, r.amount) for r in out.collect()} == {1: ("assembly-generic", 0.0, 0.0), 2: ("assembly-generic", 12.0, 24.0), 3: ("provisional-sum", None, 0.0)}


def test_skirting(spark):
    rows = [("LIVING — GF", "PR01"), ("MAID'S BATH", "BATHROOM"), ("PEDESTRIAN ENTRANCE", "ST03"), ("STAIRCASE", "ST01"), ("Stair Landing (GF - Upper)", "ST01"), ("MASTER BALCONY", "PR01"), ("FAMILY ROOM TERRACE", "ST01"),
            ("VERANDA", "ST01"), ("LIVING", None), ("LIVING", ""), ("HALL — BALCONY SIDE", "PR01"), ("UPSTAIRS HALL", "PR01"), (None, "PR01")]
    got = filters.skirtable(spark.createDataFrame(rows, "description string, finish_code string")).collect()
    assert [r.description for r in got] == ["LIVING — GF", "HALL — BALCONY SIDE", "UPSTAIRS HALL", None]


def test_floor_names(spark):
    rows = ["GF", "L1", "L2", "Roof", "Ground Floor", "FF", "First Floor", "first floor", None, "", "   ", "Penthouse", " \tPenthouse "]
    assert values(spark, "string", rows, S.floor_name) == ["GF", "L1", "L2", "Roof", "GF", "L1", "L1", "L1", None, None, None, "Penthouse", "Penthouse"]
    assert values(spark, "string", ["ST01", "st01", " ST01", "BATHROOM", "ST02", None], S.is_floor_legend_code) == [True, False, False, True, False, None]


def test_tags(spark):
    rows = ["D-123", "D-12", "d02", "CW-10", "CW04", "W3", "ABCD1", "ABCDE1", "D 2", "D1234", " D-2 ", "", None]
    assert values(spark, "string", rows, S.tag_label) == ["D123", "D12", "D02", "CW10", "CW04", "W3", "ABCD1", None, None, None, "D2", None, None]


def test_serials_are_never_cut(spark):
    assert values(spark, "int", [1, 999, 1000, 123456], lambda c: S.serial(c, 3)) == ["001", "999", "1000", "123456"]
    n = 1200
    rows = [(1, k, "DOOR", f"D-{k}", "x", "nr", 1.0, None, "AI") for k in range(n)]
    items = spark.createDataFrame(rows, "project_id int, item_no bigint, category string, tag string, description string, unit string, qty_ai double, qty_final double, status string")
    refs = [r.ref for r in quantify.generate_bill(items, F.lit(True)).collect()]
    assert len(set(refs)) == n and any(r.endswith("/1200") for r in refs)
