"""Relations dealt by order: what a task holds does not grow with the table, and lines travel once."""

import re

import pytest

from planwright import plans, session
from planwright.plans import export
from planwright.sources.views import view

SF = "/root/testdata/sf0.01"


def test_tasks_of_dealt_items_are_of_the_stated_size(spark, monkeypatch):
    monkeypatch.setattr(session, "DEALT_ROWS", 1_000)
    items = view(spark, SF, "takeoff", dealt=True).select("project_id", "item_no")
    sizes = [n for n in items.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect() if n]
    assert sum(sizes) == view(spark, SF, "takeoff").count() and max(sizes) < 2_000
    assert sorted(items.collect()) == sorted(view(spark, SF, "takeoff").select("project_id", "item_no").collect())


@pytest.mark.parametrize("name", ["c17_tag_coverage", "g02_all_findings", "c22_located_rooms"])
def test_tasks_follow_the_rows(spark, monkeypatch, name):
    monkeypatch.setattr(session, "DEALT_ROWS", 1_000)
    n = 1 + view(spark, SF, "lineitem").count() // 1_000
    assert re.search(rf"Exchange hashpartitioning\(l_orderkey#\d+L?, {n}\)", plans.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString())


def test_lines_of_a_dump_move_once(spark, monkeypatch):
    """before, they were dealt twice by order, the sums by project, and all rows once more by range."""
    seen = []
    write = export.text_sink.write_lines
    monkeypatch.setattr(export.text_sink, "write_lines", lambda rows, *a, **k: seen.append(rows) or write(rows, *a, **k))
    monkeypatch.setattr(session, "DEALT_ROWS", 1_000)
    places = [r.place for r in plans.QUERIES["a12_workbook_dump"](spark, SF).select("place").collect()]
    plan = seen[0]._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Exchange rangepartitioning(l_orderkey" in plan, plan
    assert sorted(places) == list(range(seen[0].count()))
