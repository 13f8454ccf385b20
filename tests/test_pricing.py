"""The whole waterfall and rules as rows on small tables: tiers, containment, wall features, nulls, ties, no rows."""

import pytest
from pyspark.sql import functions as F

from planwright.operators import pricing, rules

LINE = "id int, org_id bigint, category string, tag string, description string, unit string, finish_code string, qty double, item_id bigint, rate double, source string, is_provisional boolean, ps_amount double"
ASSEMBLY = "assembly_id bigint, org_id bigint, takeoff_category string, applies_to string, output_unit string, finish_codes array<string>, sort_order int"
COMPONENT = "assembly_id bigint, kind string, unit_price double, coverage double, coats int, wastage_pct double, fixed_cost double"


def line(k, category, tag=None, unit="m²", finish=None, qty=2.0, item=1, org=1, rate=None, source=None, provisional=False, ps=None, description=""):
    return (k, org, category, tag, description, unit, finish, qty, item, rate, source, provisional, ps)


@pytest.fixture(scope="module")
def tables(spark):
    assemblies = [
        (1, 1, "FLOOR_FINISH", "FLOOR", "sqm", ["ST01", "PR01"], 1), (2, 1, "FLOOR_FINISH", "FLOOR", "m2", [], 5), (3, 1, "FLOOR_FINISH", "FLOOR", "m2", None, 5), (4, 1, None, "WALL", "m2", None, 1),
        (5, 1, None, "CEILING", "m2", None, 1), (6, 1, None, "GENERIC", "m2", None, 1), (7, 2, "FLOOR_FINISH", "FLOOR", "m2", None, 1), (8, 1, "DOOR", "GENERIC", "m2", None, 0), (9, 3, None, "WALL", "m2", None, 1)]
    components = [(k, "LABOR", 10.0 * k, None, None, None, None) for k in range(1, 9)]
    rates = [(None, "PAINT-INT", "m2", 3.0), (1, "PAINT-INT", "nr", 4.0), (None, "DOOR-STD-LACQ", "No", 900.0), (2, "DOOR-STD-LACQ", "each", 800.0), (None, "WALL-WOODPORC", "m2", 77.0), (None, "KIT-BASE", "lm", None)]
    return spark.createDataFrame(assemblies, ASSEMBLY), spark.createDataFrame(components, COMPONENT), spark.createDataFrame(rates, "org_id bigint, code string, unit string, rate double")


def test_tiers(spark, tables):
    lines = [
        line(1, "FLOOR_FINISH", finish="PR01"), line(2, "FLOOR_FINISH", finish="ZZ"), line(3, "FLOOR_FINISH", finish=None), line(4, "FLOOR_FINISH", finish="ST01", org=2),
        line(5, "PAINT"), line(6, "PAINT", org=3), line(7, "PAINT", org=2), line(8, "DOOR", unit="nr"), line(9, "DOOR", unit="each", org=2), line(10, "WALL_FINISH", "WF-WD01"), line(11, "WALL_FINISH", "WF-ZZ"),
        line(12, "WALL_FINISH", "WF-PAINT", org=3), line(13, "JOINERY", "KB-1", unit="lm"), line(14, "MEP_HVAC", unit="No", rate=5.0, source="mep-rule:x", provisional=True, ps=9.0), line(15, "MEP_HVAC", source="mep-rule:y"),
        line(16, "OTHER", item=None, provisional=True, ps=1000.0), line(17, "OTHER", item=None, provisional=False, ps=1000.0), line(18, "OTHER", provisional=True, ps=1000.0), line(19, "SCREED", qty=None), line(20, None, unit=None, org=None), line(5, "PAINT")]
    out = pricing.price_bill(spark.createDataFrame(lines, LINE), *tables).collect()
    got = {r.id: (r.source, r.rate, r.amount, r.ps_amount) for r in out}
    assert len(out) == 21 and got == {
        1: ("assembly:1", 10.0, 20.0, None), 2: ("assembly:2", 20.0, 40.0, None), 3: ("assembly:2", 20.0, 40.0, None), 4: ("assembly:7", 70.0, 140.0, None),
        # Two assemblies serve walls of organisation 1, so none does; its own rate is in another unit, and hides the shared one.
        5: ("provisional-sum", None, 0.0, None), 6: ("assembly:9", 0.0, 0.0, None), 7: ("rate-library:global:PAINT-INT", 3.0, 6.0, None),
        8: ("rate-library:global:DOOR-STD-LACQ", 900.0, 1800.0, None), 9: ("rate-library:org:DOOR-STD-LACQ", 800.0, 1600.0, None), 10: ("rate-library:global:WALL-WOODPORC", 77.0, 154.0, None), 11: ("provisional-sum", None, 0.0, None),
        12: ("assembly:9", 0.0, 0.0, None), 13: ("provisional-sum", None, 0.0, None), 14: ("mep-rule:x", 5.0, 10.0, None), 15: ("mep-rule:y", 0.0, 0.0, None),
        16: ("provisional-sum", None, 0.0, 1000.0), 17: ("provisional-sum", None, 0.0, None), 18: ("provisional-sum", None, 0.0, None), 19: ("assembly:6", 60.0, 0.0, None), 20: ("provisional-sum", None, 0.0, None)}
    assert all(r.is_provisional == (r.source == "provisional-sum") for r in out)


def test_no_lines_and_no_tables(spark, tables):
    none = [t.limit(0) for t in tables]
    lines = spark.createDataFrame([line(1, "PAINT"), line(2, "DOOR", unit="nr")], LINE)
    assert pricing.price_bill(lines.limit(0), *tables).collect() == []
    assert {r.source for r in pricing.price_bill(lines, *none).collect()} == {"provisional-sum"}


ITEM = "project_id int, category string, description string, finish_code string, door_count int, width_mm double, height_mm double, qty_ai double, qty_final double"


def test_rules_are_rows(spark):
    items = spark.createDataFrame([
        (1, "ROOM", "Main STAIRCASE", "ST01", 10, 300.0, None, 4.0, 5.0), (1, "ROOM", "STAIRCASE 2", None, 5, None, 1000.0, 9.0, None), (1, "ROOM", "HALL", "ST01", 9, 9.0, 9.0, 9.0, None),
        (1, "DOOR", "d", None, 3, 900.0, None, None, None), (1, "DOOR", "d", None, 2, None, None, None, None), (2, "DOOR", "d", None, None, None, None, None, None), (3, "MEP_HVAC", "x", None, 1, None, None, None, None), (None, "DOOR", "d", None, 1, 800.0, None, None, None)], ITEM)
    more = [("added", "DOOR_COUNT", 0.05, "OTHER", "STOP", "No", "C", "stop", None, None), ("served", "DOOR_COUNT", None, "OTHER", "S", "nr", "C", "s", "{n} of {qty}", "SERVICES_ITEMS"), ("nobody", "UNKNOWN", 1.0, "OTHER", "U", "nr", "C", "u", "r", None)]
    out = rules.run_rules(items, rules.registry(spark, [*rules.RULES, *more]))
    got = {(r.project_id, r.tag): (r.qty, r.unit, r.reasoning) for r in out.collect()}
    assert got == {
        (1, "STAIR-TREAD"): (8.0, "lm", "Σ stair tread length = 8.00 lm"), (1, "STAIR-LAND"): (5.0, "m²", "Σ landing area = 5.00 m²"), (1, "STAIR-HANDRAIL"): (8.0, "rm", "Handrail length = stair length = 8.00 rm"),
        (1, "THRESHOLD"): (2.7, "lm", "Σ door widths = 2.70 lm (across 5 doors)"), (1, "IRONMONGERY"): (5.0, "nr", "1 ironmongery set per door × 5 doors"), (1, "STOP"): (1.0, "No", None),
        (None, "THRESHOLD"): (0.8, "lm", "Σ door widths = 0.80 lm (across 1 door)"), (None, "IRONMONGERY"): (1.0, "nr", "1 ironmongery set per door × 1 doors"), (None, "STOP"): (1.0, "No", None)}
    assert rules.run_rules(items.limit(0), rules.registry(spark)).collect() == []
    with pytest.raises(ValueError):
        rules.measured(items, [rules.Measure("x", "true", "1", "median")])


def test_measures_take_one_aggregation(spark):
    items = spark.createDataFrame([(1, "ROOM", "a", None, 1, 1.0, 1.0, 1.0, None)], ITEM)
    counted = rules.measured(items, [*rules.MEASURES, rules.Measure("NAMES", "category = 'ROOM'", "description", "distinct")])
    assert {r.measure: r.amount for r in counted.where(F.col("n") > 0).collect()} == {"NAMES": 1.0}
    plan = rules.measured(items, rules.MEASURES)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
