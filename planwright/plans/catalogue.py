"""Procurement, material costing and finder queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from planwright.functions import numbers as N
from planwright.functions.strings import serial
from planwright.operators import filters, pick
from planwright.operators.costing import cost_by_category, cost_by_material, project_totals, space_measures, surface_lines
from planwright.plans.registry import query

R2 = "FLOOR(({0}) * 100 + 0.5) / 100"


@query("a01_tenant_scan", "SELECT project_id, client_id, status FROM project WHERE org_id = 3", ("project",))
def tenant_scan(v):
    return filters.tenant(v("project"), 3).select("project_id", "client_id", "status")


@query("a02_listing", "SELECT supplier_id, name, preferred FROM supplier_d WHERE preferred ORDER BY name LIMIT 25", ("supplier_d",))
def listing(v):
    return filters.listing(v("supplier_d"), {"preferred": True}, [("name", False)], 25).select("supplier_id", "name", "preferred")


@query("a03_point_lookup", "SELECT * FROM material WHERE material_id = 42", ("material",))
def lookup(v):
    return filters.listing(v("material"), {"material_id": 42})


@query("b04_price_history_since", "SELECT material_id, supplier_id, price, effective_date FROM price_snapshot WHERE effective_date >= TIMESTAMP '2000-06-01'", ("price_snapshot",))
def price_history(v):
    since = F.try_to_timestamp(F.lit("2000-06-01")).cast("timestamp_ntz")
    return v("price_snapshot").where(F.col("effective_date") >= since).select("material_id", "supplier_id", "price", "effective_date")


@query("b07_shared_rates", "SELECT code, unit, CAST(rate AS DOUBLE) AS rate, org_id IS NULL AS is_global FROM rate_library WHERE org_id = 3 OR org_id IS NULL", ("rate_library",))
def shared_rates(v):
    return filters.tenant(v("rate_library"), 3, shared=True).select("code", "unit", F.col("rate").cast("double").alias("rate"), F.col("org_id").isNull().alias("is_global"))


@query("b09_items_of_projects", "SELECT project_id, item_no, category FROM takeoff t WHERE EXISTS (SELECT 1 FROM project p WHERE p.project_id = t.project_id AND status = 'F' AND org_id = 3)", ("takeoff", "project"))
def items_of_projects(v):
    wanted = v("project").where("status = 'F' AND org_id = 3").select("project_id")
    return v("takeoff").join(wanted, "project_id", "left_semi").select("project_id", "item_no", "category")


@query("b10_material_finder", """
SELECT material_id, name, category, unit_price FROM material
WHERE contains(lower(name || ' ' || brand), 'brand#1') AND category IN ('tiles', 'marble', 'grout', 'glue', 'other') AND unit_price >= 950 AND unit_price <= 1050 AND active""", ("material",))
def material_finder(v):
    return filters.find_materials(v("material"), "Brand#1", usage="floor", low=950, high=1050, active_only=True, text_columns=("name", "brand")).select("material_id", "name", "category", "unit_price")


@query("b11_supplier_finder", "SELECT supplier_id, name FROM supplier_d WHERE contains(lower(name), '1') AND preferred", ("supplier_d",))
def supplier_finder(v):
    return v("supplier_d").where(F.lower("name").contains("1") & F.col("preferred")).select("supplier_id", "name")


@query("d26_price_range", "SELECT coalesce(floor(min(unit_price)), 0) AS low, coalesce(ceil(max(unit_price)), 0) AS high FROM material WHERE active", ("material",))
def price_range(v):
    zero = F.lit(0.0)
    return v("material").where("active").agg(
        F.coalesce(F.floor(F.min("unit_price")).cast("double"), zero).alias("low"), F.coalesce(F.ceil(F.max("unit_price")).cast("double"), zero).alias("high"))


@query("e01_procurement", f"""
, a AS (SELECT material_id, min((price, supplier_id, currency)) c, min((price, supplier_id, currency)) FILTER (preferred) o, count(*) n FROM live_price GROUP BY 1),
b AS (SELECT material_id, n, c[1] cp, c[2] cs, c[3] cc, o[1] op, o[2] os, o[3] oc FROM a),
d AS (SELECT *, oc = cc AND os <> cs AND op - cp > 0 ok FROM b)
SELECT material_id, n AS n_prices, cs AS cheapest_supplier, cp AS cheapest_price, os AS preferred_supplier, op AS preferred_price,
  CASE WHEN ok THEN {R2.format('op - cp')} END AS saving, CASE WHEN ok THEN {R2.format('(op - cp) / op * 100')} END AS saving_pct FROM d""", ("live_price",))
def procurement(v):
    return pick.procurement(v("live_price"))


_TREND = """
, a AS (SELECT {k}, min((effective_date, seq, seq2, supplier_id, price)) a, max((effective_date, seq, seq2, supplier_id, price)) b, count(*) n FROM price_snapshot GROUP BY {k}),
b AS (SELECT {k}, a[5] fp, b[5] lp, n, CASE WHEN a[5] > 0 THEN FLOOR((b[5] - a[5]) / a[5] * 100 * 100 + 0.5) / 100 ELSE 0 END pct FROM a)
SELECT {k}, fp AS first_price, lp AS last_price, n, CAST(pct AS DOUBLE) AS pct, CASE WHEN abs(pct) < 1.5 THEN 'stable' WHEN pct > 0 THEN 'up' ELSE 'down' END AS trend FROM b"""


@query("e03_price_trend", _TREND.format(k="material_id"), ("price_snapshot",))
def price_trend(v):
    return pick.price_trend(v("price_snapshot"), ["material_id"])


@query("e03_price_trend_by_supplier", _TREND.format(k="material_id, supplier_id").replace("supplier_id, price)", "supplier_id, price)"), ("price_snapshot",))
def price_trend_by_supplier(v):
    return pick.price_trend(v("price_snapshot"), ["material_id", "supplier_id"])


@query("e04_price_series", """
SELECT material_id, supplier_id, string_agg(CAST(CAST(round(price * 100) AS BIGINT) AS VARCHAR), ',' ORDER BY effective_date, seq, seq2, price) AS cents
FROM price_snapshot WHERE material_id % 10 = 0 GROUP BY 1, 2""".replace(" WHERE material_id % 10 = 0", ""), ("price_snapshot",))
def price_series(v):
    rows = F.array_sort(F.collect_list(F.struct("effective_date", "seq", "seq2", "price")))
    cents = F.array_join(F.transform(rows, lambda r: F.round(r["price"] * 100).cast("long").cast("string")), ",")
    return v("price_snapshot").groupBy("material_id", "supplier_id").agg(cents.alias("cents"))


@query("f02_price_order", """
SELECT material_id, supplier_id, row_number() OVER (PARTITION BY material_id ORDER BY preferred DESC, price, supplier_id) AS place FROM live_price""", ("live_price",))
def price_order(v):
    by = Window.partitionBy("material_id").orderBy(F.desc("preferred"), "price", "supplier_id")
    return v("live_price").select("material_id", "supplier_id", F.row_number().over(by).cast("long").alias("place"))


@query("d32_chart_domain", """
SELECT material_id, min(price) - (max(price) - min(price)) * 0.1 AS low, max(price) + (max(price) - min(price)) * 0.1 AS high FROM price_snapshot GROUP BY 1""", ("price_snapshot",))
def chart_domain(v):
    low, high = F.min("price"), F.max("price")
    return v("price_snapshot").groupBy("material_id").agg((low - (high - low) * 0.1).alias("low"), (high + (high - low) * 0.1).alias("high"))


_CLEAN = "greatest(coalesce({0}, 0.0), 0.0)"
_SURFACE = """
, m AS (SELECT *, length_m * width_m AS floor_area, 2 * (length_m + width_m) AS perimeter, 2 * (length_m + width_m) * height_m AS wall_area FROM space),
s AS (SELECT project_id, space_no, 'floor' surface, floor_material material, floor_area area FROM m
  UNION ALL SELECT project_id, space_no, 'wall', wall_material, wall_area FROM m UNION ALL SELECT project_id, space_no, 'ceiling', ceiling_material, floor_area FROM m),
j AS (SELECT s.*, material_id, category, unit, unit_price, coverage, waste_pct FROM s LEFT JOIN material ON material = material_id),
q AS (SELECT *, CASE WHEN coverage > 0 THEN CASE WHEN unit IN ('bag', 'piece') THEN ceil(area * (1 + waste_pct / 100) / coverage)
  ELSE FLOOR(area * (1 + waste_pct / 100) / coverage * 100 + 0.5) / 100 END ELSE 0 END AS quantity FROM j)
"""


@query("h20_space_measures", """
SELECT project_id, space_no, length_m * width_m AS floor_area, 2 * (length_m + width_m) AS perimeter, 2 * (length_m + width_m) * height_m AS wall_area FROM space""", ("space",))
def measures(v):
    return space_measures(v("space")).select("project_id", "space_no", "floor_area", "perimeter", "wall_area")


@query("i12_cost_breakdown", _SURFACE + """
SELECT project_id, space_no, surface, material_id, CAST(area AS DOUBLE) AS area, CASE WHEN material_id IS NULL THEN 0 ELSE quantity END AS quantity,
  CASE WHEN material_id IS NULL THEN FLOOR(area * CASE surface WHEN 'wall' THEN 180 ELSE 280 END * 100 + 0.5) / 100 ELSE FLOOR(quantity * unit_price * 100 + 0.5) / 100 END AS cost FROM q""", ("space", "material"))
def cost_breakdown(v):
    return surface_lines(v("space"), v("material")).select("project_id", "space_no", "surface", "material_id", "area", "quantity", "cost")


_BY_MATERIAL = _SURFACE + """
, g AS (SELECT project_id, material_id, category, unit, unit_price, coverage, waste_pct, CAST(sum(CAST(area AS DECIMAL(18,4))) AS DOUBLE) area, count(*) n_surfaces
  FROM j WHERE material_id IS NOT NULL GROUP BY ALL),
l AS (SELECT *, CASE WHEN coverage > 0 THEN CASE WHEN unit IN ('bag', 'piece') THEN ceil(area * (1 + waste_pct / 100) / coverage)
  ELSE FLOOR(area * (1 + waste_pct / 100) / coverage * 100 + 0.5) / 100 END ELSE 0 END AS quantity FROM g),
c AS (SELECT *, FLOOR(quantity * unit_price * 100 + 0.5) / 100 AS cost FROM l)
"""


@query("d09_cost_by_material", _BY_MATERIAL + "SELECT project_id, material_id, area, n_surfaces, quantity, cost FROM c", ("space", "material"))
def by_material(v):
    return cost_by_material(surface_lines(v("space"), v("material"))).select("project_id", "material_id", "area", "n_surfaces", "quantity", "cost")


@query("d10_cost_by_category", _BY_MATERIAL + """
SELECT project_id, category, CAST(sum(CAST(cost AS DECIMAL(18,2))) AS DOUBLE) AS cost,
  CAST(sum(CAST(cost AS DECIMAL(18,2))) AS DOUBLE) / nullif(CAST(sum(sum(CAST(cost AS DECIMAL(18,2)))) OVER (PARTITION BY project_id) AS DOUBLE), 0) AS share FROM c GROUP BY 1, 2""", ("space", "material"))
def by_category(v):
    return cost_by_category(cost_by_material(surface_lines(v("space"), v("material"))))


@query("d12_project_totals", _SURFACE + """
SELECT project_id, CAST(sum(CASE WHEN surface = 'floor' THEN CAST(area AS DECIMAL(18,4)) END) AS DOUBLE) AS floor_area,
  CAST(sum(CASE WHEN surface = 'wall' THEN CAST(area AS DECIMAL(18,4)) END) AS DOUBLE) AS wall_area,
  count(*) FILTER (material_id IS NOT NULL) AS assigned, count(*) FILTER (material_id IS NULL) AS unassigned, bool_and(material_id IS NOT NULL) AS fully_assigned FROM j GROUP BY 1""", ("space", "material"))
def totals(v):
    return project_totals(surface_lines(v("space"), v("material")))


@query("d28_org_report", """
, p AS (SELECT org_id, count(*) n FROM project GROUP BY 1), s AS (SELECT org_id, count(*) n FROM supplier_d GROUP BY 1)
SELECT o.org_id, org_name, coalesce(p.n, 0) AS projects, coalesce(s.n, 0) AS suppliers FROM organization o LEFT JOIN p USING (org_id) LEFT JOIN s USING (org_id)""", ("organization", "project", "supplier_d"))
def org_report(v):
    out = v("organization")
    for relation, name in [("project", "projects"), ("supplier_d", "suppliers")]:
        out = out.join(v(relation).groupBy("org_id").agg(F.count(F.lit(1)).alias(name)), "org_id", "left")
    return out.select("org_id", "org_name", F.coalesce("projects", F.lit(0)).alias("projects"), F.coalesce("suppliers", F.lit(0)).alias("suppliers"))


@query("h30_quotation", """
SELECT project_id, FLOOR((sum(CAST(price AS DECIMAL(14,2))) * 0.95e0) * (1 + 5 / 100e0) * 100 + 0.5) / 100 AS total FROM takeoff GROUP BY 1""", ("takeoff",))
def quotation(v):
    subtotal = F.sum(F.col("price").cast("decimal(14,2)")).cast("double")
    return v("takeoff").groupBy("project_id").agg(N.round2(N.quotation_total(subtotal, subtotal - subtotal * 0.95, F.lit(5))).alias("total"))


@query("e19_quotation_reference", """
SELECT project_id, concat('Q-', org_id, '-', strftime(created_at, '%Y%m'), '-', printf('%04d', row_number() OVER (PARTITION BY org_id, strftime(created_at, '%Y%m') ORDER BY created_at, project_id))) AS ref,
  created_at + INTERVAL 30 DAY AS valid_until FROM project""", ("project",))
def quotation_reference(v):
    month = F.date_format("created_at", "yyyyMM")
    number = F.row_number().over(Window.partitionBy("org_id", month).orderBy("created_at", "project_id"))
    ref = F.concat(F.lit("Q-"), F.col("org_id").cast("string"), F.lit("-"), month, F.lit("-"), serial(number, 4))
    return v("project").select("project_id", ref.alias("ref"), (F.col("created_at") + F.expr("INTERVAL 30 DAYS")).alias("valid_until"))
