"""Queries on whole costs: components of assemblies, measures and costs of projects, floors by finish."""

from __future__ import annotations

from pyspark.sql import functions as F

from planwright.operators import costing, pricing, quantify
from planwright.plans.catalogue import _BY_MATERIAL, _SURFACE
from planwright.plans.quantities import _BILLABLE
from planwright.plans.registry import query


@query("d16_cost_breakdown", """
SELECT assembly_id, sort_order, kind AS label, kind, round(CASE kind WHEN 'MATERIAL' THEN CASE WHEN coverage = 0 THEN 0 ELSE CAST(unit_price AS DOUBLE) / CAST(coalesce(coverage, 1) AS DOUBLE) * coats * (1 + CAST(wastage_pct AS DOUBLE) / 100) END
  WHEN 'LABOR' THEN CAST(unit_price AS DOUBLE) ELSE CASE WHEN assembly_id % 3 = 0 THEN 0 ELSE CAST(fixed_cost AS DOUBLE) / (assembly_id % 3 * 120) END END, 6) AS contribution, kind = 'TOOL_FIXED' AND assembly_id % 3 = 0 AS tools_skipped FROM assembly_component""", ("assembly_component",))
def cost_breakdown(v):
    """What each component adds to a unit of its assembly; tools are shared out over the quantity that the project has of it, if any."""
    out = pricing.cost_parts(v("assembly_component").withColumn("label", F.lit(None).cast("string")), F.col("assembly_id") % 3 * 120)
    return out.select("assembly_id", "sort_order", "label", "kind", F.round("contribution", 6).alias("contribution"), "tools_skipped")


@query("d12_project_measures", """
, m AS (SELECT project_id, count(*) AS n_spaces, sum(length_m * width_m) AS floor_area, sum(2 * (length_m + width_m) * height_m) AS wall_area, sum(2 * (length_m + width_m)) AS perimeter FROM space GROUP BY 1)
SELECT project_id, n_spaces, round(floor_area, 4) AS floor_area, round(wall_area, 4) AS wall_area, round(floor_area, 4) AS ceiling_area, round(perimeter, 4) AS perimeter, floor(round(floor_area, 4) * 280 * 100 + 0.5) / 100 AS floor_cost,
  floor(round(wall_area, 4) * 180 * 100 + 0.5) / 100 AS wall_cost, floor((round(floor_area, 4) * 280 + round(wall_area, 4) * 180) * 100 + 0.5) / 100 AS total_cost FROM m""", ("space",))
def project_measures(v):
    """Measures of all spaces of a project and their cost by default rates, rounded once."""
    return costing.project_measures(v("space"))


@query("d10_grand_totals", _BY_MATERIAL.rstrip() + """,
a AS (SELECT project_id, sum(CAST(cost AS DECIMAL(18,2))) AS lines FROM c GROUP BY 1),
u AS (SELECT project_id, count(*) AS n, sum(CAST(area AS DECIMAL(18,4))) AS area, sum(CAST(floor(area * CASE surface WHEN 'wall' THEN 180 ELSE 280 END * 100 + 0.5) / 100 AS DECIMAL(18,2))) AS amount FROM j WHERE material_id IS NULL GROUP BY 1)
SELECT project_id, CAST(coalesce(lines, 0) AS DOUBLE) AS lines_total, CAST(coalesce(n, 0) AS BIGINT) AS unassigned, CAST(coalesce(area, 0) AS DOUBLE) AS unassigned_area, CAST(coalesce(amount, 0) AS DOUBLE) AS unassigned_amount,
  CAST(coalesce(lines, 0) + coalesce(amount, 0) AS DOUBLE) AS grand_total FROM a FULL JOIN u USING (project_id)""", ("space", "material"))
def grand_totals(v):
    """What a project's bill by material and its surfaces without one come to."""
    return costing.grand_totals(costing.surface_lines(v("space"), v("material")))


@query("d01_floor_groups", _BILLABLE + r"""
, r AS (SELECT project_id, item_no, coalesce(finish_code, 'unassigned') AS finish, CAST(q AS DECIMAL(14,4)) AS q, trim(split_part(description, '—', 1)) AS name FROM billable WHERE q > 0 AND NOT regexp_matches(split_part(description, '—', 1), '\bSTAIRCASE\b', 'i')),
n AS (SELECT *, row_number() OVER (PARTITION BY project_id, finish ORDER BY item_no) AS k FROM r),
g AS (SELECT project_id, finish, CAST(sum(q) AS DOUBLE) AS area, count(*) AS n, string_agg(name, ', ' ORDER BY k) FILTER (k <= 8) AS names FROM n GROUP BY 1, 2)
SELECT project_id, finish, 'FF-' || finish AS tag, area, n AS n_rooms, CASE WHEN finish = 'unassigned' THEN 'PARAMETRIC' ELSE 'DERIVED' END AS basis, CASE WHEN finish = 'unassigned' THEN 50 ELSE 85 END AS confidence,
  'Σ floor area over ' || n || CASE WHEN n = 1 THEN ' room' ELSE ' rooms' END || ' with finish_code=' || finish || '; rooms: ' || names || CASE WHEN n > 8 THEN ', …(+' || (n - 8) || ')' ELSE '' END AS note FROM g""", ("takeoff",))
def floor_groups(v):
    """Floor finishes as derived rows: area, rooms and what they are derived from."""
    return quantify.floor_groups(v("takeoff").where("category = 'ROOM'"))
