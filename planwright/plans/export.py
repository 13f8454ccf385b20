"""Queries that export bills: summary, rows of all tabs, the dump in order, names of tabs, quotations."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from planwright.functions.numbers import quotation_total, round2
from planwright.operators import workbook
from planwright.plans.registry import query
from planwright.session import work_dir
from planwright.sources import text_sink

_LINES = """, w AS (SELECT project_id, category AS section, item_no, description, unit, qty, rate, CAST(qty * rate AS DECIMAL(18,2)) AS amount, ps_amount, is_provisional AS ps, confidence < 60 AS draft FROM boq_line)"""
_SUMS = """, s AS (SELECT project_id, section, count(*) FILTER (NOT draft) AS n, coalesce(sum(amount) FILTER (NOT draft AND NOT ps), 0) AS priced, coalesce(sum(CAST(ps_amount AS DECIMAL(18,2))) FILTER (NOT draft AND ps), 0) AS provisional,
  count(*) FILTER (draft) AS n_draft, coalesce(sum(amount) FILTER (draft AND NOT ps), 0) AS draft FROM w GROUP BY 1, 2)"""


def bill_lines(v):
    """Bill lines with their amounts; those of little confidence have placeholder rates."""
    return v("boq_line").select("project_id", F.col("category").alias("section"), "item_no", "description", "unit", "qty", "rate", (F.col("qty") * F.col("rate")).cast("decimal(18,2)").alias("amount"), "ps_amount",
                                "is_provisional", (F.col("confidence") < 60).alias("is_placeholder"))


def terms(v):
    """Discount and VAT of every project; some have none."""
    return v("project").select("project_id", F.when(F.col("project_id") % 4 != 3, F.col("project_id") % 4 * 250).cast("decimal(14,2)").alias("discount"), (F.col("project_id") % 3 * 2.5).cast("decimal(5,2)").alias("vat_pct"))


@query("a12_workbook_summary", _LINES + _SUMS + """
, t AS (SELECT project_id, CAST(sum(priced) AS DOUBLE) AS priced, CAST(sum(provisional) AS DOUBLE) AS provisional, CAST(sum(n_draft) AS BIGINT) AS n_draft, CAST(sum(draft) AS DOUBLE) AS draft FROM s GROUP BY 1),
d AS (SELECT *, CAST(CASE WHEN project_id % 4 = 3 THEN 0 ELSE project_id % 4 * 250 END AS DOUBLE) AS discount, CAST(project_id % 3 AS DOUBLE) * 2.5::DOUBLE AS vat FROM t),
e AS (SELECT *, priced - discount AS aft, CASE WHEN vat > 0 THEN (priced - discount) * (vat / 100) ELSE 0 END AS tax FROM d)
SELECT project_id, 1 AS kind, section, section AS label, CAST(priced AS DOUBLE) AS priced, CAST(provisional AS DOUBLE) AS provisional FROM s WHERE n > 0
UNION ALL SELECT project_id, 0, NULL, 'Placeholder rates: ' || n_draft || ' line(s) moved to the draft tab', draft, NULL FROM e WHERE n_draft > 0
UNION ALL SELECT project_id, 2, NULL, 'Measured / priced subtotal', priced, NULL FROM e
UNION ALL SELECT project_id, 3, NULL, 'Discount (priced only)', -discount, NULL FROM e WHERE discount > 0
UNION ALL SELECT project_id, 4, NULL, 'VAT on priced (' || CASE vat WHEN 2.5 THEN '2.50' ELSE '5.00' END || '%)', tax, NULL FROM e WHERE vat > 0
UNION ALL SELECT project_id, 5, NULL, 'Priced subtotal (after discount + VAT)', aft + tax, NULL FROM e WHERE vat > 0
UNION ALL SELECT project_id, 6, NULL, 'Provisional sums', NULL, provisional FROM e
UNION ALL SELECT project_id, 7, NULL, 'GRAND TOTAL (priced + P/S)', NULL, aft + tax + provisional FROM e""", ("boq_line",))
def workbook_summary(v):
    """The summary tab of every bill."""
    return workbook.summary(bill_lines(v), terms(v))


_ROWS = _LINES + _SUMS + """
, r AS (SELECT project_id, CASE WHEN draft THEN 2 ELSE 1 END AS tab_no, section, 0 AS kind, item_no, CASE WHEN draft THEN 'DRAFT MEP — not for pricing' ELSE section END AS tab,
    concat_ws(chr(9), item_no, description, qty, unit, CASE WHEN ps THEN 'P/S' ELSE CAST(rate AS VARCHAR) END, CASE WHEN ps THEN coalesce(CAST(ps_amount AS DECIMAL(18,2)), 0.00) ELSE amount END) AS line FROM w
  UNION ALL SELECT project_id, 1, section, 1, NULL, section, 'Subtotal — ' || section || ' priced' || chr(9) || CAST(priced AS DECIMAL(28,2)) FROM s WHERE n > 0
  UNION ALL SELECT project_id, 1, section, 2, NULL, section, 'Subtotal — ' || section || ' P/S' || chr(9) || CAST(provisional AS DECIMAL(28,2)) FROM s WHERE n > 0 AND provisional > 0
  UNION ALL SELECT project_id, 1, section, 3, NULL, section, 'Section ' || section || ' total (priced + P/S)' || chr(9) || CAST(priced + provisional AS DECIMAL(28,2)) FROM s WHERE n > 0
  UNION ALL SELECT project_id, 2, section, 4, NULL, 'DRAFT MEP — not for pricing', 'Subtotal — ' || section || ' DRAFT (not for pricing)' || chr(9) || CAST(draft AS DECIMAL(28,2)) FROM s WHERE n_draft > 0
  UNION ALL SELECT project_id, 3, NULL, 5, NULL, 'DRAFT MEP — not for pricing', 'DRAFT MEP total (would have been added if confirmed)' || chr(9) || CAST(sum(draft) AS DECIMAL(28,2)) FROM s GROUP BY 1 HAVING sum(n_draft) > 0)"""
_ORDER = ["project_id", "tab_no", "section", "kind", "item_no"]


@query("a12_workbook_rows", _ROWS + " SELECT * FROM r", ("boq_line",))
def workbook_rows(v):
    """The rows of the section tabs and of the draft tab of every bill."""
    return workbook.tab_rows(bill_lines(v))


@query("a12_workbook_dump", _ROWS + " SELECT row_number() OVER (ORDER BY project_id, tab_no, section NULLS FIRST, kind, item_no NULLS FIRST) - 1 AS place, project_id || chr(9) || tab || chr(9) || line AS line FROM r", ("boq_line",), dealt="ranges")
def workbook_dump(v):
    """The same rows of all bills as ordered text files, read back. Lines move once, in ranges of projects, and are written where they come."""
    rows = workbook.tab_rows(bill_lines(v))
    spark = rows.sparkSession
    rows = rows.withColumn("line", F.concat_ws("\t", F.col("project_id").cast("string"), "tab", "line"))
    return text_sink.read_lines(spark, text_sink.write_lines(rows, "line", [F.col(c) for c in _ORDER], f"{work_dir(spark)}/workbook-{uuid.uuid4().hex}", "bills", 20_000, ranged=True))


@query("h14_tab_names", r"""
, n AS (SELECT material_id, name || CASE material_id % 3 WHEN 0 THEN ' / [' WHEN 1 THEN ': *' ELSE ' \?' END || brand || '] of the longer names' AS name FROM material)
SELECT material_id, trim(left(regexp_replace(name, '[\\/?*\[\]:]', ' ', 'g'), 31)) AS tab FROM n""", ("material",))
def tab_names(v):
    middle = F.when(F.col("material_id") % 3 == 0, " / [").when(F.col("material_id") % 3 == 1, ": *").otherwise(" \\?")
    return v("material").select("material_id", workbook.tab_name(F.concat("name", middle, "brand", F.lit("] of the longer names"))).alias("tab"))


@query("h30_quotation_terms", """
, s AS (SELECT project_id, CAST(sum(CAST(price AS DECIMAL(14,2))) AS DOUBLE) AS sub FROM takeoff GROUP BY 1),
t AS (SELECT *, CAST(CASE WHEN project_id % 4 = 3 THEN 0 ELSE project_id % 4 * 250 END AS DOUBLE) AS discount, CAST(project_id % 3 AS DOUBLE) * 2.5::DOUBLE AS vat, CAST(project_id % 5 AS DOUBLE) * 40 - 20 AS asked FROM s),
u AS (SELECT *, greatest(0, least(100, asked)) AS tax FROM t), x AS (SELECT *, floor(sub * tax / 100 * 100 + 0.5) / 100 AS tax_amount FROM u)
SELECT project_id, floor((sub - discount) * (1 + vat / 100) * 100 + 0.5) / 100 AS total, CAST(tax AS DOUBLE) AS tax_rate, tax_amount, floor((sub + tax_amount) * 100 + 0.5) / 100 AS grand_total FROM x""", ("takeoff",))
def quotation_terms(v):
    """Quotations by each project's discount and VAT, and by a tax rate that is brought into 0 to 100."""
    sub = v("takeoff").groupBy("project_id").agg(F.sum(F.col("price").cast("decimal(14,2)")).cast("double").alias("sub"))
    known = terms(v).select("project_id", F.coalesce(F.col("discount").cast("double"), F.lit(0.0)).alias("discount"), F.col("vat_pct").cast("double").alias("vat"))
    both = sub.join(known, "project_id")
    rate = F.greatest(F.lit(0.0), F.least(F.lit(100.0), (F.col("project_id") % 5).cast("double") * 40 - 20))
    both = both.withColumn("tax_rate", rate).withColumn("tax_amount", round2(F.col("sub") * F.col("tax_rate") / 100))
    return both.select("project_id", round2(quotation_total(F.col("sub"), F.col("discount"), F.col("vat"))).alias("total"), "tax_rate", "tax_amount", round2(F.col("sub") + F.col("tax_amount")).alias("grand_total"))
