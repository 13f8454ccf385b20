"""Bill generation: buckets, routes, promotion, pending rates, carried lines, numbers beyond 999, nulls and no rows."""

import pytest

from planwright.operators import bill

ITEM = "project_id int, item_id bigint, category string, tag string, description string, unit string, qty double, status string, kind string, rate_code string, rate_hint string, floor_code string, ceiling_code string, rule_id string, rule_rate double, factor_confidence double, rate_confidence double"
HAND = "project_id int, section string, sort_order int, description string, unit string, qty double, rate double, amount double, ps_amount double, is_provisional boolean"


def item(k, category, project=1, tag=None, qty=2.0, status="AI", kind=None, code=None, hint=None, floor=None, ceiling=None, rule=None, rate=None, factor=None, sure=None):
    return (project, k, category, tag, f"item {k}", "nr", qty, status, kind, code, hint, floor, ceiling, rule, rate, factor, sure)


@pytest.fixture
def made(spark):
    def run(items, overrides=(), served=(), prior=()):
        rates = spark.createDataFrame([("DOOR-1", 10.0), ("DOOR-0", 0.0), ("FF-ST01", None)], "code string, rate double")
        out = bill.generate(
            spark.createDataFrame(items, ITEM), rates, spark.createDataFrame([("PAINT",), ("PAINT",)], "category string"), spark.createDataFrame(list(overrides), "project_id int, category string, estimability string"),
            spark.createDataFrame([(p,) for p in served], "project_id int"), spark.createDataFrame(list(prior), HAND))
        return sorted(out.collect(), key=lambda r: (r.project_id or 0, r.section, len(r.ref), r.ref))

    return run


def test_buckets_of_a_section(made):
    rows = made([
        item(1, "DOOR", tag="D2", code="DOOR-1"), item(2, "DOOR", tag="D1", code="DOOR-1"), item(3, "DOOR", code="DOOR-0"), item(4, "DOOR", code="DOOR-9"), item(5, "DOOR", status="APPROVED", qty=None), item(6, "DOOR", qty=0.0), item(7, "DOOR", kind="LEGEND", code="DOOR-1"),
        item(8, "WINDOW"), item(9, "WINDOW"), item(10, "ROOM"), item(11, "AREA_STATEMENT"), item(12, "DOOR", tag=None, code="DOOR-1")],
        prior=[(1, "2.8", 7, "by hand", "LS", 1.0, None, None, 500.0, True), (1, "2.8", 3, "earlier", "LS", None, 2.0, 2.0, None, False)])
    assert [(r.ref, r.bucket, r.item_id, r.warning) for r in rows] == [
        ("2.8/001", 1, 2, None), ("2.8/002", 1, 1, None), ("2.8/003", 1, 5, None), ("2.8/004", 1, 12, None), ("2.8/005", 2, None, None), ("2.8/006", 4, 3, "RATE_MISSING"), ("2.8/007", 4, 4, "RATE_SLOT_MISSING"), ("2.8/008", 5, None, None), ("2.8/009", 5, None, None)]
    said = [r.description for r in rows]
    assert said[4] == "WINDOW — provisional sum (P/S, allowance to be confirmed); rolled up from 2 takeoff items" and said[5:7] == ["[RATE MISSING — populate DOOR-0] item 3", "[RATE SLOT MISSING — add DOOR-9] item 4"]
    assert said[7:] == ["earlier", "by hand"] and rows[8].ps_amount == 500.0 and rows[2].qty == 0.0 and [r.is_provisional for r in rows] == [False] * 4 + [True] + [False] * 3 + [True]


def test_routes(made):
    hvac = lambda k, project, **more: item(k, "MEP_HVAC", project, rule="r", rate=3.0, status="APPROVED", **more)
    rows = made([
        hvac(1, 1), hvac(2, 2), hvac(3, 2, factor=0.5, sure=0.5), hvac(4, 2, factor=0.5, sure=0.6), hvac(5, 3), item(6, "JOINERY", 1), item(7, "JOINERY", 3, status="EDITED"), item(8, "MEP_PROV", 2, status="APPROVED"), hvac(9, 4), item(10, "ODD", 1), item(11, None, 1), item(12, "PAINT", None), item(13, "SKIRTING", 2)],
        overrides=[(3, "MEP_HVAC", "LUMP_SUM"), (3, "JOINERY", "MEASURED"), (4, "MEP_HVAC", "PLACEHOLDER"), (None, "PAINT", "PLACEHOLDER"), (2, "SKIRTING", "PROVISIONAL")], served=[2, 2])
    got = {(r.project_id, r.category): (r.bucket, r.section, r.n_items) for r in rows if r.category != "MEP_HVAC"}
    # An override of a word that none may be counts as none; one that says provisional is no provisional sum.
    assert got == {(1, "JOINERY"): (3, "2.6", 1), (3, "JOINERY"): (1, "2.6", 1), (2, "MEP_PROV"): (2, "4.0", 1), (1, "ODD"): (2, "1.0", 1), (None, "PAINT"): (1, "2.9", 1), (2, "SKIRTING"): (4, "2.9", 1)}
    hv = [(r.project_id, r.bucket, r.item_id, r.rate, r.amount, r.rate_source, r.ps_amount) for r in rows if r.category == "MEP_HVAC"]
    assert sorted(hv, key=str) == sorted([(1, 2, None, None, None, None, 252000.0), (2, 1, 2, 3.0, 6.0, "mep-rule:r", None), (2, 1, 4, 3.0, 6.0, "mep-rule:r", None), (3, 2, None, None, None, None, 252000.0)], key=str)
    assert next(r.description for r in rows if r.project_id == 1 and r.category == "MEP_HVAC") == "HVAC — provisional sum (P/S 252,000 AED, contractor-typical allowance); rolled up from 1 takeoff item"


def test_numbers_and_no_rows(made):
    rows = made([item(k, "DOOR", status="APPROVED") for k in range(1100)], prior=[(1, "2.8", 1, "x", "LS", 1.0, None, None, 1.0, True)])
    assert rows[-1].ref == "2.8/1101" and len({r.ref for r in rows}) == 1101
    assert made([]) == []
    assert [r.ref for r in made([], prior=[(7, "4.0", 1, None, None, None, None, None, None, None)])] == ["4.0/001"]
