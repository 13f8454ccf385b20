"""Take-off, bill, audit and queue queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from planwright.functions import numbers as N
from planwright.functions.strings import serial
from planwright.operators import pick
from planwright.operators.pricing import bill_totals, rate_waterfall, unit_costs
from planwright.plans.registry import query

_UNIT = """CASE lower(trim({0})) WHEN 'nr' THEN 'nr' WHEN 'no' THEN 'nr' WHEN 'each' THEN 'nr' WHEN 'ea' THEN 'nr' WHEN 'm²' THEN 'm²' WHEN 'm2' THEN 'm²' WHEN 'sqm' THEN 'm²'
  WHEN 'm' THEN 'lm' WHEN 'lm' THEN 'lm' WHEN 'linear' THEN 'lm' WHEN 'metres' THEN 'lm' WHEN 'meters' THEN 'lm' WHEN 'lumpsum' THEN 'lumpsum' WHEN 'ls' THEN 'lumpsum' WHEN 'lot' THEN 'lumpsum' ELSE lower(trim({0})) END"""
_TOTALS = """
SELECT {k}, coalesce(CAST(sum(CASE WHEN NOT is_provisional THEN CAST(qty * rate AS DECIMAL(18,2)) END) AS DOUBLE), 0) AS priced,
  coalesce(CAST(sum(CASE WHEN is_provisional THEN ps_amount END) AS DOUBLE), 0) AS provisional,
  count(*) FILTER (NOT is_provisional) AS n_priced, count(*) FILTER (is_provisional) AS n_provisional FROM boq_line GROUP BY {k}"""


@query("d07_bill_totals", _TOTALS.format(k="project_id"), ("boq_line",))
def totals(v):
    return bill_totals(v("boq_line"), ["project_id"])


@query("d08_section_totals", _TOTALS.format(k="project_id, category"), ("boq_line",))
def section_totals(v):
    return bill_totals(v("boq_line"), ["project_id", "category"])


_COSTS = """
, cost AS (SELECT assembly_id, CAST(sum(CAST(CASE kind WHEN 'MATERIAL' THEN CASE WHEN coverage = 0 THEN 0 ELSE CAST(unit_price AS DOUBLE) / CAST(coalesce(coverage, 1) AS DOUBLE) * coats * (1 + CAST(wastage_pct AS DOUBLE) / 100) END
    WHEN 'LABOR' THEN CAST(unit_price AS DOUBLE) ELSE {tools} END AS DECIMAL(28,12))) AS DOUBLE) AS unit_cost FROM assembly_component GROUP BY 1)"""
_NO_TOOLS = _COSTS.format(tools="0")


@query("d16_unit_costs", _COSTS.format(tools="CAST(fixed_cost AS DOUBLE) / 500") + " SELECT assembly_id, round(unit_cost, 4) AS unit_cost FROM cost", ("assembly_component",))
def costs(v):
    return unit_costs(v("assembly_component"), project_qty=500.0).withColumn("unit_cost", F.round("unit_cost", 4))


@query("c07_rate_waterfall", _NO_TOOLS + f"""
, l AS (SELECT b.*, p.org_id, concat('R', part_id % 14) AS code, {_UNIT.format('unit')} AS u FROM boq_line b JOIN project p USING (project_id)),
a AS (SELECT assembly.*, {_UNIT.format('output_unit')} AS u, coalesce(unit_cost, 0) AS cost FROM assembly LEFT JOIN cost USING (assembly_id)),
ks AS (SELECT DISTINCT category, u, finish_code FROM l),
own AS (SELECT category, ks.u, ks.finish_code, arg_min(cost, (sort_order, assembly_id)) AS own_rate FROM ks JOIN a ON takeoff_category = category AND a.u = ks.u
  AND (a.finish_code IS NULL OR a.finish_code = ks.finish_code) GROUP BY ALL),
loose AS (SELECT category, k.u, min(cost) AS loose_rate FROM (SELECT DISTINCT category, u, CASE WHEN category = 'CEILING' THEN 'CEILING' WHEN category IN ('WALL_FINISH', 'PAINT', 'PLASTER') THEN 'WALL' WHEN category IN ('FLOOR_FINISH', 'SCREED') THEN 'FLOOR' END AS surface FROM ks) k
  JOIN a ON takeoff_category IS NULL AND surface IS NOT NULL AND (applies_to = 'GENERIC' OR applies_to = surface) AND a.u = k.u GROUP BY ALL HAVING count(*) = 1),
r AS (SELECT l.*, own_rate, loose_rate, coalesce(o.code, g.code) IS NOT NULL AS has, CASE WHEN o.code IS NOT NULL THEN {_UNIT.format('o.unit')} ELSE {_UNIT.format('g.unit')} END AS ru,
    CAST(CASE WHEN o.code IS NOT NULL THEN o.rate ELSE g.rate END AS DOUBLE) AS rr
  FROM l LEFT JOIN own ON own.category = l.category AND own.u = l.u AND own.finish_code IS NOT DISTINCT FROM l.finish_code
  LEFT JOIN loose ON loose.category = l.category AND loose.u = l.u
  LEFT JOIN rate_library o ON o.org_id = l.org_id AND o.code = l.code LEFT JOIN rate_library g ON g.org_id IS NULL AND g.code = l.code),
s AS (SELECT project_id, item_no, qty, CASE WHEN own_rate IS NOT NULL THEN 'assembly' WHEN loose_rate IS NOT NULL THEN 'assembly-generic' WHEN has AND ru = u THEN 'rate-library' ELSE 'provisional-sum' END AS source,
  coalesce(own_rate, loose_rate, CASE WHEN ru = u THEN rr END) AS rate FROM r)
SELECT project_id, item_no, source, rate, coalesce(FLOOR(CAST(qty AS DOUBLE) * rate * 100 + 0.5) / 100, 0) AS amount FROM s""",
       ("boq_line", "project", "assembly", "assembly_component", "rate_library"))
def waterfall(v):
    lines = v("boq_line").drop("rate").join(v("project").select("project_id", "org_id"), "project_id").withColumn("code", F.concat(F.lit("R"), (F.col("part_id") % 14).cast("string")))
    out = rate_waterfall(lines, v("assembly"), v("assembly_component"), v("rate_library"))
    return out.select("project_id", "item_no", "source", "rate", "amount")


@query("d20_duplicate_tags", """
SELECT project_id, category, tag, count(*) AS n, string_agg(CAST(item_no AS VARCHAR), ',' ORDER BY item_no) AS items FROM takeoff WHERE tag IS NOT NULL GROUP BY 1, 2, 3 HAVING count(*) > 1""", ("takeoff",))
def duplicate_tags(v):
    items = F.array_join(F.transform(F.array_sort(F.collect_list("item_no")), lambda i: i.cast("string")), ",")
    return v("takeoff").where("tag IS NOT NULL").groupBy("project_id", "category", "tag").agg(F.count(F.lit(1)).alias("n"), items.alias("items")).where("n > 1")


@query("d01_floor_by_finish", """
SELECT project_id, coalesce(finish_code, 'unassigned') AS finish, sum(CAST(coalesce(qty_final, qty_ai) AS DECIMAL(14,4)))::DOUBLE AS area, count(*) AS n
FROM takeoff WHERE category = 'ROOM' AND NOT regexp_matches(upper(description), 'STAIR') AND coalesce(qty_final, qty_ai) > 0 GROUP BY 1, 2""", ("takeoff",))
def floor_by_finish(v):
    rooms = v("takeoff").withColumn("q", F.coalesce("qty_final", "qty_ai")).where((F.col("category") == "ROOM") & ~F.upper("description").contains("STAIR") & (F.col("q") > 0))
    return rooms.groupBy("project_id", F.coalesce("finish_code", F.lit("unassigned")).alias("finish")).agg(F.sum(F.col("q").cast("decimal(14,4)")).cast("double").alias("area"), F.count(F.lit(1)).alias("n"))


@query("d04_doors", """
SELECT project_id, sum(door_count) AS doors, sum(CASE WHEN width_mm IS NOT NULL THEN door_count * width_mm / 1000 END) AS metres FROM takeoff WHERE category = 'DOOR' GROUP BY 1""", ("takeoff",))
def doors(v):
    width = F.when(F.col("width_mm").isNotNull(), F.col("door_count") * F.col("width_mm") / 1000)
    return v("takeoff").where("category = 'DOOR'").groupBy("project_id").agg(F.sum("door_count").alias("doors"), F.sum(width).alias("metres"))


@query("j03_unit_sanity", """
SELECT project_id, item_no, 'UNIT_SANITY' AS rule, 'ERROR' AS severity FROM takeoff
WHERE (category = 'DOOR' AND (width_mm NOT BETWEEN 400 AND 2500 OR height_mm NOT BETWEEN 1800 AND 3500)) OR (category = 'WINDOW' AND (width_mm NOT BETWEEN 300 AND 6000 OR height_mm NOT BETWEEN 300 AND 6000))""", ("takeoff",))
def unit_sanity(v):
    out = lambda c, low, high: ~F.col(c).between(low, high)
    door = (F.col("category") == "DOOR") & (out("width_mm", 400, 2500) | out("height_mm", 1800, 3500))
    window = (F.col("category") == "WINDOW") & (out("width_mm", 300, 6000) | out("height_mm", 300, 6000))
    return v("takeoff").where(door | window).select("project_id", "item_no", F.lit("UNIT_SANITY").alias("rule"), F.lit("ERROR").alias("severity"))


@query("e08_newest_by_tag", """
SELECT project_id, category, tag, item_no FROM (SELECT *, row_number() OVER (PARTITION BY project_id, category, tag ORDER BY created_at DESC, item_no) AS rn FROM takeoff WHERE tag IS NOT NULL) WHERE rn = 1""", ("takeoff",))
def newest(v):
    return pick.first_by(v("takeoff").where("tag IS NOT NULL"), ["project_id", "category", "tag"], [F.desc("created_at"), F.col("item_no")]).select("project_id", "category", "tag", "item_no")


@query("e11_line_reference", """
SELECT project_id, item_no, concat(category, '/', printf('%03d', row_number() OVER (PARTITION BY project_id, category ORDER BY item_no))) AS ref FROM boq_line""", ("boq_line",))
def line_reference(v):
    number = F.row_number().over(Window.partitionBy("project_id", "category").orderBy("item_no"))
    return v("boq_line").select("project_id", "item_no", F.concat(F.col("category"), F.lit("/"), serial(number, 3)).alias("ref"))


@query("l02_fair_claim", """
, due AS (SELECT * FROM job WHERE status = 'QUEUED' AND (scheduled_for IS NULL OR scheduled_for <= TIMESTAMP '2030-01-01')),
served AS (SELECT org_id, max(started_at) AS last_served FROM job GROUP BY 1)
SELECT org_id, last_served, arg_min(job_id, (due.created_at, job_id)) AS next_job, count(*) AS n_due FROM due LEFT JOIN served USING (org_id) GROUP BY 1, 2""", ("job",))
def fair_claim(v):
    """By organisation with due work: when it was last served, and its oldest due job. The least last_served is served next."""
    now = F.lit("2030-01-01").cast("timestamp_ntz")
    due = (F.col("status") == "QUEUED") & (F.col("scheduled_for").isNull() | (F.col("scheduled_for") <= now))
    out = v("job").groupBy("org_id").agg(F.max("started_at").alias("last_served"), F.min(F.when(due, F.struct("created_at", "job_id")))["job_id"].alias("next_job"), F.count_if(due).alias("n_due"))
    return out.where("n_due > 0")


@query("l03_reaper", """
SELECT job_id, CASE WHEN attempts < 3 THEN 'QUEUED' ELSE 'FAILED' END AS status, CASE WHEN attempts < 3 THEN 'reaped' ELSE 'timeout' END AS error
FROM job WHERE status = 'RUNNING' AND started_at < (SELECT max(created_at) FROM job) - INTERVAL '30' MINUTE""", ("job",))
def reaper(v):
    """Runs that began before the time limit go back to the queue at once, or fail for good after three attempts."""
    now = v("job").agg(F.max("created_at").alias("now"))
    late = v("job").where("status = 'RUNNING'").join(F.broadcast(now), F.col("started_at") < F.col("now") - F.expr("INTERVAL '30' MINUTE"))
    again = F.col("attempts") < 3
    return late.select("job_id", F.when(again, "QUEUED").otherwise("FAILED").alias("status"), F.when(again, "reaped").otherwise("timeout").alias("error"))


@query("l04_retry", """
SELECT job_id, CASE WHEN attempts >= 3 THEN 'FAILED' ELSE 'QUEUED' END AS status,
  CASE WHEN attempts < 3 THEN CASE attempts WHEN 0 THEN 2 WHEN 1 THEN 4 ELSE 8 END END AS wait_s FROM job WHERE status = 'FAILED'""", ("job",))
def retry(v):
    """A failed run waits 2 to the attempts times 2 seconds and goes back to the queue; after three attempts it has failed."""
    again = F.col("attempts") < 3
    return v("job").where("status = 'FAILED'").select("job_id", F.when(again, "QUEUED").otherwise("FAILED").alias("status"), F.when(again, N.backoff_seconds(F.col("attempts")).cast("int")).alias("wait_s"))
