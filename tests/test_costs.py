"""Costs of assemblies and projects and floors by finish: the given figures, nulls, zeros, repeats and empty tables."""

from pyspark.sql import functions as F

from planwright.operators import costing, pricing, quantify

PARTS = "assembly_id int, label string, kind string, unit_price double, coverage double, coats int, wastage_pct double, fixed_cost double, qty int"


def test_cost_parts(spark):
    rows = [(1, None, "MATERIAL", 60.0, 12.0, 2, 5.0, None, None), (1, "two", "MATERIAL", 60.0, 0.0, 2, 5.0, None, None), (1, None, "MATERIAL", 7.0, None, None, None, None, None), (1, "work", "LABOR", 9.7, None, None, None, None, None),
            (1, None, "LABOR", None, None, None, None, None, None), (1, "t", "TOOL_FIXED", None, None, None, None, 150.0, 500), (1, None, "TOOL_FIXED", None, None, None, None, 150.0, 0), (1, None, None, None, None, None, None, None, None)]
    data = spark.createDataFrame(rows, PARTS)
    out = sorted((r.label or "", round(r.contribution, 6), r.tools_skipped) for r in pricing.cost_parts(data, F.col("qty")).collect())
    assert out == sorted([("MATERIAL", 10.5, False), ("two", 0.0, False), ("MATERIAL", 7.0, False), ("work", 9.7, False), ("LABOR", 0.0, False), ("t", 0.3, False), ("TOOL_FIXED", 0.0, True), ("", 0.0, True)])
    whole = pricing.unit_costs(data.where("label IS NOT NULL OR kind = 'MATERIAL'"), 500).collect()[0].unit_cost
    assert round(whole, 6) == 27.5 and pricing.cost_parts(data.limit(0), F.col("qty")).collect() == []


def test_project_measures(spark):
    rows = [(1, 4.0, 3.0, 2.5), (1, 4.0, 3.0, 2.5), (1, float("nan"), -3.0, None), (2, None, None, None)]
    out = {r.project_id: tuple(r)[1:] for r in costing.project_measures(spark.createDataFrame(rows, "project_id int, length_m double, width_m double, height_m double")).collect()}
    assert out == {1: (3, 24.0, 70.0, 24.0, 28.0, 6720.0, 12600.0, 19320.0), 2: (1, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0)}
    assert costing.project_measures(spark.createDataFrame([], "project_id int, length_m double, width_m double, height_m double")).collect() == []


def test_grand_totals(spark):
    spaces = spark.createDataFrame([(1, 1, 4.0, 3.0, 2.5, 7, None, None), (2, 1, 1.0, 1.0, 1.0, None, None, 9), (3, 1, 2.0, 2.0, 1.0, 7, 7, 7)], "project_id int, space_no int, length_m double, width_m double, height_m double, floor_material int, wall_material int, ceiling_material int")
    materials = spark.createDataFrame([(7, "tiles", "m2", 10.0, 1.0, 10.0)], "material_id int, category string, unit string, unit_price double, coverage double, waste_pct double")
    out = {r.project_id: tuple(r)[1:] for r in costing.grand_totals(costing.surface_lines(spaces, materials)).collect()}
    assert out == {1: (132.0, 2, 47.0, 35 * 180.0 + 12 * 280, 132.0 + 35 * 180 + 12 * 280), 2: (0.0, 3, 6.0, 280.0 * 2 + 180 * 4, 280.0 * 2 + 180 * 4), 3: (176.0, 0, 0.0, 0.0, 176.0)}


def test_floor_groups(spark):
    rows = [(1, k, f"ROOM {k} — FF", "ST01", 1.25, None) for k in range(10)] + [(1, 90, "Staircase", "ST01", 5.0, None), (1, 91, "BIG", "ST01", 0.0, None), (1, 92, "HALL — STAIRCASE SIDE", None, 2.0, 3.0), (1, 93, "PLOT AREA", None, 50.0, None),
            (2, 1, None, "PR01", 1.0, None), (2, 2, "A", "PR01", None, None)]
    items = spark.createDataFrame(rows, "project_id int, item_no int, description string, finish_code string, qty_ai double, qty_final double").withColumn("category", F.lit("ROOM")).withColumn("name", F.lit("clash"))
    out = {r.tag: tuple(r) for r in quantify.floor_groups(items).collect()}
    assert out["FF-ST01"][3:] == (12.5, 10, "DERIVED", 85, "Σ floor area over 10 rooms with finish_code=ST01; rooms: " + ", ".join(f"ROOM {k}" for k in range(8)) + ", …(+2)")
    assert out["FF-unassigned"][3:] == (3.0, 1, "PARAMETRIC", 50, "Σ floor area over 1 room with finish_code=unassigned; rooms: HALL") and out["FF-PR01"][3:5] == (1.0, 1)
    assert quantify.floor_groups(items.limit(0)).collect() == [] and len(out) == 3
