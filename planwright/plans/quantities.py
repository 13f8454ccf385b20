"""Quantify, services, bill generation and label pairing queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from planwright.functions import numbers as N
from planwright.functions import strings as S
from planwright.operators import filters, quantify, spatial
from planwright.plans.registry import query

_STATEMENT = (r"\bvilla\b|\bplot\b|\bproposed\b|\bbua\b|^\s*ground\s*floor(\s|$|—)|^\s*first\s*floor(\s|$|—)|^\s*roof(\s|$|—)|\bsetting\s*out\b|\bplan\s*area\b"
              r"|\bgarage\s*block\b|\baccessible\s*roof\b|\bnon[\s-]*accessible\s*roof\b|\bplot\s*boundary\b")
_BILLABLE = f"""
, rooms AS (SELECT *, coalesce(qty_final, qty_ai) AS q FROM takeoff WHERE category = 'ROOM'),
billable AS (SELECT * FROM rooms WHERE NOT regexp_matches(description, '{_STATEMENT}', 'i'))"""


def _case(column: str, values: dict, default: str) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {v!r}" for k, v in values.items()) + f" ELSE {default} END"


@query("b16_billable_rooms", _BILLABLE + " SELECT project_id, item_no, description FROM billable", ("takeoff",))
def billable(v):
    return filters.billable_rooms(v("takeoff")).select("project_id", "item_no", "description")


@query("b14_area_statements", _BILLABLE + f" SELECT project_id, item_no, description FROM rooms WHERE regexp_matches(description, '{_STATEMENT}', 'i')", ("takeoff",))
def statements(v):
    return filters.area_statements(v("takeoff")).select("project_id", "item_no", "description")


@query("d02_screed", _BILLABLE + r"""
, r AS (SELECT project_id, coalesce(finish_code, 'unassigned') AS f, q FROM billable WHERE q > 0 AND NOT regexp_matches(description, '\bSTAIRCASE\b', 'i'))
SELECT project_id, coalesce(sum(q) FILTER (f NOT IN ('ST03', 'unassigned')), 0) AS area, coalesce(string_agg(DISTINCT f, ',' ORDER BY f) FILTER (f NOT IN ('ST03', 'unassigned')), '') AS included,
  coalesce(string_agg(DISTINCT f, ',' ORDER BY f) FILTER (f IN ('ST03', 'unassigned')), '') AS excluded FROM r GROUP BY 1""", ("takeoff",))
def screed(v):
    return quantify.screed(v("takeoff").where("category = 'ROOM'"))


@query("d03_ceilings", _BILLABLE + r"""
, r AS (SELECT project_id, q, CASE WHEN regexp_matches(upper(description), '\b(BALCONY|TERRACE|GARAGE|VOID|MAID''?S ROOM)\b') OR finish_code = 'ST03' THEN NULL
  WHEN regexp_matches(upper(description), '\b(BATH|TOILET|POWDER|WC|LAUNDRY|KITCHEN)\b') THEN 'CL02' ELSE 'CL03' END AS ceiling FROM billable)
SELECT project_id, ceiling, sum(q) AS area, count(*) AS n FROM r WHERE ceiling IS NOT NULL AND q > 0 GROUP BY 1, 2""", ("takeoff",))
def ceilings(v):
    return quantify.ceilings(v("takeoff").where("category = 'ROOM'"))


_RATIO = r"""CASE WHEN regexp_matches(description, '\b(corridor|passage|hall)\b', 'i') THEN 5.0 WHEN regexp_matches(description, '\b(balcony|terrace|veranda)\b', 'i') THEN 3.0
  WHEN regexp_matches(description, '\b(bath|wc|toilet|powder|lavatory|restroom)\b', 'i') THEN 1.4 WHEN regexp_matches(description, '\bkitchen\b', 'i') THEN 1.5
  WHEN regexp_matches(description, '\b(foyer|lobby|entrance)\b', 'i') THEN 1.5 WHEN regexp_matches(description, '\b(garage|driver|maid|laundry|linen|store|storage|utility|mep)\b', 'i') THEN 1.3
  WHEN regexp_matches(description, '\b(bedroom|bd|guest|master|family|play|dining|dinning|living|sitting|study)\b', 'i') THEN 1.4 ELSE 1.3 END"""


@query("i04_wall_runs", rf"""
, r AS (SELECT project_id, item_no, coalesce(qty_final, qty_ai) AS a, CAST({_RATIO} AS DOUBLE) AS k FROM takeoff WHERE category = 'ROOM' AND finish_code IS NOT NULL
  AND finish_code NOT IN ('BATHROOM', 'ST03') AND finish_code <> '' AND NOT regexp_matches(split_part(description, '—', 1), '\b(stair|staircase|balcony|terrace|veranda)\b', 'i')),
m AS (SELECT project_id, item_no, 2 * (sqrt(a * k) + sqrt(a / k)) AS run FROM r WHERE a > 0)
SELECT project_id, item_no, floor(run * 100 + 0.5) / 100 AS skirting_m, floor(run * CAST(2.8 AS DOUBLE) * 100 + 0.5) / 100 AS paint_m2 FROM m""", ("takeoff",))
def wall_runs(v):
    return quantify.wall_runs(v("takeoff"))


_DRIVERS = _BILLABLE + r"""
, k AS (SELECT project_id, q, coalesce(finish_code, 'unassigned') AS f, trim(regexp_replace(upper(description), '[^A-Z0-9]+', ' ', 'g')) AS key, upper(split_part(description, '—', 1)) AS name FROM billable),
m AS (SELECT project_id, CAST(count(DISTINCT key) AS DOUBLE) AS "ROOM_COUNT", CAST(count(DISTINCT key) FILTER (regexp_matches(name, '\b(BATH|TOILET|POWDER|WC)\b')) AS DOUBLE) AS "BATHROOM_COUNT",
  CAST(count(DISTINCT key) FILTER (regexp_matches(name, '\bKITCHEN\b')) AS DOUBLE) AS "KITCHEN_COUNT", CAST(count(DISTINCT key) FILTER (regexp_matches(name, '\bBEDROOM\b')) AS DOUBLE) AS "BEDROOM_COUNT",
  coalesce(sum(q) FILTER (f NOT IN ('ST03', 'unassigned') AND NOT regexp_matches(name, '\bSTAIRCASE\b')), 0) AS "AREA_M2" FROM k GROUP BY 1),
w AS (SELECT *, "AREA_M2" * CAST(10.7639 AS DOUBLE) AS "AREA_FT2" FROM m),
d AS (UNPIVOT w ON "ROOM_COUNT", "BATHROOM_COUNT", "KITCHEN_COUNT", "BEDROOM_COUNT", "AREA_M2", "AREA_FT2" INTO NAME driver VALUE amount)"""


@query("d06_services_drivers", _DRIVERS + " SELECT project_id, driver, amount FROM d", ("takeoff",))
def drivers(v):
    return quantify.services_drivers(v("takeoff"))


@query("i03_services_quantities", _DRIVERS + """
SELECT project_id, rule_id, d.driver, CASE WHEN unit IN ('No', 'pt', 'LS') THEN greatest(1, floor(amount * factor + 0.5)) ELSE floor(amount * factor * 100 + 0.5) / 100 END AS qty
FROM d JOIN mep_rule USING (driver) WHERE amount * factor > 0 AND project_id IN (SELECT project_id FROM takeoff WHERE category LIKE 'MEP\\_%' ESCAPE '\\')""", ("takeoff", "mep_rule"))
def services(v):
    return quantify.services_quantities(v("takeoff"), v("mep_rule"))


@query("i08_generate_bill", f"""
, t AS (SELECT *, coalesce(qty_final, qty_ai) AS q, {_case('category', quantify.SECTIONS, "'1.0'")} AS section, {_case('category', quantify.ESTIMABILITY, "'PROVISIONAL_SUM'")} AS how FROM takeoff WHERE category <> 'ROOM'),
b AS (SELECT *, CASE WHEN how = 'PROVISIONAL_SUM' THEN 2 WHEN how = 'LUMP_SUM' THEN 3 WHEN unit <> 'LS' THEN 1 ELSE 4 END AS bucket FROM t),
u AS (SELECT project_id, section, bucket, category, tag, item_no, unit, q AS qty, 1 AS n_items FROM b WHERE bucket IN (1, 4)
  UNION ALL SELECT project_id, section, bucket, category, NULL, NULL, 'LS', 1, count(*) FROM b WHERE bucket IN (2, 3) GROUP BY 1, 2, 3, 4)
SELECT project_id, concat(section, '/', printf('%03d', row_number() OVER (PARTITION BY project_id, section ORDER BY bucket, category, tag NULLS LAST, item_no))) AS ref, bucket, category, item_no, unit, qty, n_items,
  CASE WHEN bucket = 2 THEN {_case('category', quantify.ALLOWANCES, 'NULL')} END AS ps_amount FROM u""", ("takeoff",))
def bill(v):
    return quantify.generate_bill(v("takeoff"), F.col("unit") != "LS")


@query("c12_nearest_label", """
, a AS (SELECT * FROM point WHERE kind = 'AREA'), l AS (SELECT * FROM point WHERE kind = 'NAME'),
m AS (SELECT a.page, a.point_id, l.point_id AS label_id, (a.x - l.x) * (a.x - l.x) + (a.y - l.y) * (a.y - l.y) AS d2 FROM a JOIN l ON a.page = l.page),
b AS (SELECT page, point_id, arg_min(label_id, (d2, label_id)) AS label_id, min(d2) AS d2 FROM m WHERE d2 <= 900 GROUP BY 1, 2)
SELECT a.page, a.point_id, b.label_id, sqrt(b.d2) AS distance FROM a LEFT JOIN b ON a.page = b.page AND a.point_id = b.point_id""", ("point",))
def nearest(v):
    return spatial.nearest_within(v("point").where("kind = 'AREA'"), v("point").where("kind = 'NAME'"), 30.0)


@query("d11_surface_counts", """
SELECT project_id, count(floor_material) + count(wall_material) + count(ceiling_material) AS assigned, 3 * count(*) - count(floor_material) - count(wall_material) - count(ceiling_material) AS unassigned,
  bool_and(floor_material IS NOT NULL AND wall_material IS NOT NULL AND ceiling_material IS NOT NULL) AS fully_assigned FROM space GROUP BY 1""", ("space",))
def surface_counts(v):
    roles = ["floor_material", "wall_material", "ceiling_material"]
    assigned = sum((F.count(c) for c in roles[1:]), F.count(roles[0]))
    every = F.col(roles[0]).isNotNull() & F.col(roles[1]).isNotNull() & F.col(roles[2]).isNotNull()
    return v("space").groupBy("project_id").agg(assigned.alias("assigned"), (3 * F.count(F.lit(1)) - assigned).alias("unassigned"), F.bool_and(every).alias("fully_assigned"))


@query("d23_upper_median", """
SELECT material_id, list_sort(list(price))[CAST(floor(count(*) / 2) AS BIGINT) + 1] AS upper_median, max(price) AS most, max(price) > 5 * list_sort(list(price))[CAST(floor(count(*) / 2) AS BIGINT) + 1] AS too_wide
FROM price_snapshot GROUP BY 1""", ("price_snapshot",))
def upper_median(v):
    """The upper of the two middle values, from counts of equal values, so that no list of a whole group is built."""
    counts = v("price_snapshot").groupBy("material_id", "price").agg(F.count(F.lit(1)).alias("k"))
    upto = counts.withColumns({"upto": F.sum("k").over(Window.partitionBy("material_id").orderBy("price")), "n": F.sum("k").over(Window.partitionBy("material_id"))})
    middle = F.min(F.when(F.col("upto") > F.floor(F.col("n") / 2), F.col("price")))
    return upto.groupBy("material_id").agg(middle.alias("upper_median"), F.max("price").alias("most"), (F.max("price") > 5 * middle).alias("too_wide"))


@query("e13_text_lookback", r"""
WITH s AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS ls FROM documents),
p AS (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM s)
SELECT doc_id, i AS line_no, md5(array_to_string(ls[greatest(1, i - 3):i - 1], chr(10))) AS before FROM p WHERE regexp_matches(ls[i], '[0-9]')""")
def lookback(v):
    """For lines with a number, the three lines before that are not blank. Each line takes those with it before lines are dealt out."""
    lines = v("documents").select("doc_id", F.filter(F.split("text", "\n", -1), lambda x: F.trim(x) != "").alias("ls"))
    around = F.transform("ls", lambda x, i: F.struct((i + 1).cast("long").alias("line_no"), x.alias("line"), F.slice("ls", F.greatest(F.lit(1), i - 2), F.least(F.lit(3), i)).alias("before")))
    out = lines.select("doc_id", F.explode(F.filter(around, lambda s: s["line"].rlike("[0-9]"))).alias("s"))
    return out.select("doc_id", "s.line_no", F.md5(F.array_join("s.before", "\n").cast("binary")).alias("before"))
