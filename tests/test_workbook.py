"""Workbooks of bills: modes of drafts, discount and VAT, nulls, repeats and empty tables."""

import pytest
from pyspark.sql import functions as F

from planwright.operators import workbook

LINES = "project_id int, section string, item_no int, description string, unit string, qty decimal(14,4), rate decimal(14,2), amount decimal(18,2), ps_amount decimal(14,2), is_provisional boolean, is_placeholder boolean"


@pytest.fixture(scope="module")
def lines(spark):
    rows = [(1, "A", 1, "one\ttwo", "m", "2", "5", "10.10", None, False, False), (1, "A", 2, None, None, None, None, None, "7.25", True, None), (1, "B", 3, "draft", "m", "1", "3", "3.00", None, None, True),
            (1, None, 4, "x", "m", "1", "1", None, None, None, None), (2, "B", 1, "d", "m", "1", "1", "4.00", None, False, True), (2, "B", 1, "d", "m", "1", "1", "4.00", None, False, True)]
    text = spark.createDataFrame(rows, LINES.replace("decimal(14,4)", "string").replace("decimal(14,2)", "string").replace("decimal(18,2)", "string"))
    return text.select(*[F.col(c).cast("decimal(14,2)" if c in ("rate", "ps_amount") else "decimal(18,2)" if c == "amount" else "decimal(14,4)" if c == "qty" else text.schema[c].dataType).alias(c) for c in text.columns])


@pytest.fixture(scope="module")
def terms(spark):
    return spark.createDataFrame([(1, 2.0, 10.0), (1, 2.0, 10.0), (3, 1.0, 1.0)], "project_id int, discount double, vat_pct double")


def rows_of(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.orderBy("project_id", "kind", "section").collect()]


def test_summary(spark, lines, terms):
    out = rows_of(workbook.summary(lines, terms, "tab"), "project_id", "kind", "section", "priced", "provisional")
    assert out == [(1, 0, None, 3.0, None), (1, 1, None, 0.0, 0.0), (1, 1, "A", 10.1, 7.25), (1, 2, None, 10.1, None), (1, 3, None, -2.0, None), (1, 4, None, pytest.approx(0.81), None), (1, 5, None, pytest.approx(8.91), None),
                   (1, 6, None, None, 7.25), (1, 7, None, None, pytest.approx(16.16)), (2, 0, None, 8.0, None), (2, 2, None, 0.0, None), (2, 6, None, None, 0.0), (2, 7, None, None, 0.0)]
    inline = rows_of(workbook.summary(lines, terms.limit(0), "inline"), "project_id", "kind", "section", "priced", "provisional")
    assert inline == [(1, 1, None, 0.0, 0.0), (1, 1, "A", 10.1, 7.25), (1, 1, "B", 3.0, 0.0), (1, 2, None, 13.1, None), (1, 6, None, None, 7.25), (1, 7, None, None, pytest.approx(20.35)),
                      (2, 1, "B", 8.0, 0.0), (2, 2, None, 8.0, None), (2, 6, None, None, 0.0), (2, 7, None, None, 8.0)]
    labels = {r.label for r in workbook.summary(lines, terms, "exclude").collect()}
    assert "Placeholder rates: 2 line(s) excluded" in labels and "VAT on priced (10.00%)" in labels
    assert workbook.summary(lines.limit(0), terms).collect() == []
    with pytest.raises(ValueError):
        workbook.summary(lines, terms, "hidden")


def test_rows(spark, lines):
    order = ["project_id", "tab_no", "section", "kind", "item_no"]
    out = [(r.project_id, r.tab, r.line) for r in workbook.tab_rows(lines).orderBy(*order).collect()]
    draft = workbook.DRAFT_TAB
    assert out == [
        (1, "", "4\tx\t1.0000\tm\t1.00\t0.00"), (1, "", "Subtotal —  priced\t0.00"), (1, "", "Section  total (priced + P/S)\t0.00"),
        (1, "A", "1\tone two\t2.0000\tm\t5.00\t10.10"), (1, "A", "2\t\t\t\tP/S\t7.25"), (1, "A", "Subtotal — A priced\t10.10"), (1, "A", "Subtotal — A P/S\t7.25"), (1, "A", "Section A total (priced + P/S)\t17.35"),
        (1, draft, "3\tdraft\t1.0000\tm\t3.00\t3.00"), (1, draft, "Subtotal — B DRAFT (not for pricing)\t3.00"), (1, draft, "DRAFT MEP total (would have been added if confirmed)\t3.00"),
        (2, draft, "1\td\t1.0000\tm\t1.00\t4.00"), (2, draft, "1\td\t1.0000\tm\t1.00\t4.00"), (2, draft, "Subtotal — B DRAFT (not for pricing)\t8.00"), (2, draft, "DRAFT MEP total (would have been added if confirmed)\t8.00")]
    assert workbook.tab_rows(lines, "exclude").where(F.col("tab") == draft).count() == 0
    assert workbook.tab_rows(lines, "inline").where("kind = 0").count() == lines.count() and workbook.tab_rows(lines.limit(0)).collect() == []


def test_tab_names(spark):
    names = spark.createDataFrame([("A/B:C",), ("x" * 40,), (None,), (" [a]? ",)], "n string")
    assert [r[0] for r in names.select(workbook.tab_name(F.col("n"))).collect()] == ["A B C", "x" * 31, None, "a"]
