"""Queries on names, codes and orders: room keys, floors, legend codes, labels, review counts, survivors by authority."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from planwright.functions import numbers as N
from planwright.functions import strings as S
from planwright.operators import pick, quantify
from planwright.plans.bill import unit_sanity
from planwright.plans.registry import query

_ROOMS = "SELECT DISTINCT description FROM takeoff"


@query("h01_room_keys", rf"""
, n AS ({_ROOMS}),
c AS (SELECT description, trim(regexp_replace(regexp_replace(regexp_replace(upper(split_part(description, '—', 1)), '\b(?:GF|FF|RF|L1|L2|B1|B2|BF)[\s-]?\d{{1,3}}\b', '', 'g'), '[.,;:()/&-]', ' ', 'g'), '\s+', ' ', 'g')) AS t FROM n),
r AS (SELECT description, regexp_replace(regexp_replace(regexp_replace(t, '\bBED\s+ROOM\b', 'BEDROOM', 'g'), '\bBATH\s+ROOM\b', 'BATHROOM', 'g'), '\bBATHROOM\b', 'BATH', 'g') AS t FROM c)
SELECT description, array_to_string(list_sort(list_filter(string_split(t, ' '), lambda x: x NOT IN ('', 'ROOM'))), ' ') AS room_key FROM r""", ("takeoff",))
def room_keys(v):
    names = v("takeoff").select("description").distinct()
    return names.select("description", S.room_key(F.col("description")).alias("room_key"))


@query("h02_floors", """
SELECT r_regionkey, CASE r_regionkey WHEN 0 THEN 'GF' WHEN 1 THEN 'L1' WHEN 2 THEN 'L2' WHEN 3 THEN 'Roof' ELSE 'Annexe' END AS floor FROM region""")
def floors(v):
    raw = F.element_at(F.array(*[F.lit(x) for x in (" Ground Floor", "FF", "level 2", "Roof terrace", "Annexe")]), F.col("r_regionkey") + 1)
    return v("region").select("r_regionkey", S.floor_name(raw).alias("floor"))


@query("b15_not_rooms", r"""
SELECT project_id, item_no FROM takeoff WHERE category = 'ROOM' AND (length(trim(description)) > 60 OR trim(description) = '' OR (coalesce(qty_final, qty_ai) > 0 AND coalesce(qty_final, qty_ai) < 0.5)
  OR regexp_matches(description, '^\s*(up|dn|down)\s*\(?\s*stair|^\s*void\b|^\s*(garden|garden\s+area)\s*$|^\s*(north|south|east|west)\b', 'i'))""", ("takeoff",))
def not_rooms(v):
    rooms = v("takeoff").where("category = 'ROOM'")
    return rooms.where(S.is_not_a_room(F.col("description"), quantify.quantity())).select("project_id", "item_no")


@query("b17_legend_codes", "SELECT finish_code, count(*) AS n FROM takeoff WHERE finish_code IN ('ST01', 'ST03', 'PR01', 'PR03', 'BATHROOM') GROUP BY 1", ("takeoff",))
def legend_codes(v):
    return v("takeoff").where(S.is_floor_legend_code(F.col("finish_code"))).groupBy("finish_code").agg(F.count(F.lit(1)).alias("n"))


@query("b13_review_count", """
, f AS (SELECT DISTINCT project_id, item_no FROM takeoff WHERE (category = 'DOOR' AND (width_mm NOT BETWEEN 400 AND 2500 OR height_mm NOT BETWEEN 1800 AND 3500))
  OR (category = 'WINDOW' AND (width_mm NOT BETWEEN 300 AND 6000 OR height_mm NOT BETWEEN 300 AND 6000)))
SELECT t.project_id, count(*) FILTER (confidence < 85 OR f.item_no IS NOT NULL) AS n FROM takeoff t LEFT JOIN f ON f.project_id = t.project_id AND f.item_no = t.item_no GROUP BY 1""", ("takeoff",))
def review_count(v):
    """Items of low confidence or with a flag; unlike the list, estimates that nobody touched do not count as such."""
    flags = unit_sanity(v).select("project_id", "item_no").distinct().withColumn("flagged", F.lit(True))
    both = v("takeoff").join(flags, ["project_id", "item_no"], "left")
    return both.groupBy("project_id").agg(F.count_if((F.col("confidence") < 85) | F.col("flagged").isNotNull()).alias("n"))


@query("e07_authoritative", """
, r AS (SELECT *, CASE basis WHEN 'MEASURED' THEN 100 WHEN 'DERIVED' THEN 50 ELSE 0 END + confidence AS score FROM takeoff WHERE tag IS NOT NULL),
w AS (SELECT *, max(CASE WHEN basis = 'MEASURED' THEN 1 ELSE 0 END) OVER (PARTITION BY project_id, category, tag) AS has,
  row_number() OVER (PARTITION BY project_id, category, tag ORDER BY score DESC, item_no) AS rn FROM r)
SELECT project_id, category, tag, item_no FROM w WHERE has = 0 OR rn = 1""", ("takeoff",))
def authoritative(v):
    score = F.when(F.col("basis") == "MEASURED", 100).when(F.col("basis") == "DERIVED", 50).otherwise(0) + F.col("confidence")
    tagged = v("takeoff").where("tag IS NOT NULL")
    return pick.authoritative(tagged, ["project_id", "category", "tag"], score, [F.col("item_no")], F.col("basis") == "MEASURED").select("project_id", "category", "tag", "item_no")


@query("h06_tag_labels", r"""
SELECT DISTINCT tag, CASE WHEN regexp_full_match(trim(tag), '[A-Za-z]{1,4}-?[0-9]{1,3}') THEN upper(replace(trim(tag), '-', '')) END AS label FROM takeoff WHERE tag IS NOT NULL""", ("takeoff",))
def tag_labels(v):
    return v("takeoff").where("tag IS NOT NULL").select("tag", S.tag_label(F.col("tag")).alias("label")).distinct()


@query("h14_slugs", "SELECT p_partkey, regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS slug FROM part")
def slugs(v):
    return v("part").select("p_partkey", S.slug(F.col("p_name")).alias("slug"))


@query("h32_confidence", "SELECT project_id, item_no, CASE WHEN confidence <= 1 THEN confidence ELSE confidence / 100.0::DOUBLE END AS sure FROM takeoff", ("takeoff",))
def confidence(v):
    return v("takeoff").select("project_id", "item_no", N.normal_confidence(F.col("confidence").cast("double")).alias("sure"))


@query("h27_dimensions", """
SELECT project_id, item_no, abs(width_mm - 900) <= 45 OR abs(height_mm - 900) <= 45 AS fits FROM takeoff WHERE category = 'DOOR' AND width_mm IS NOT NULL""", ("takeoff",))
def dimensions(v):
    """Doors of which one side is within 5 % of 900 mm, either way round."""
    near = lambda c: N.within_percent(F.col(c), F.lit(900.0), 5)
    return v("takeoff").where("category = 'DOOR' AND width_mm IS NOT NULL").select("project_id", "item_no", (near("width_mm") | near("height_mm")).alias("fits"))


@query("d05_stairs", """
SELECT project_id, sum(CASE WHEN width_mm > 0 THEN door_count * width_mm / 1000 ELSE NULLIF(door_count * height_mm / 1000, 0) END) AS total_lm, count(*) AS n
FROM takeoff WHERE regexp_matches(description, '\\bSTAIRCASE\\b', 'i') AND category = 'ROOM' GROUP BY 1""".replace("\\\\", "\\"), ("takeoff",))
def stairs(v):
    """Risers times tread, else risers times width: the door columns of the synthetic items stand for these."""
    metres = F.when(F.col("width_mm") > 0, F.col("door_count") * F.col("width_mm") / 1000).otherwise(F.nullif(F.col("door_count") * F.col("height_mm") / 1000, F.lit(0.0)))
    rooms = v("takeoff").where((F.col("category") == "ROOM") & F.col("description").rlike(r"(?i)\bSTAIRCASE\b"))
    return rooms.groupBy("project_id").agg(F.sum(metres).alias("total_lm"), F.count(F.lit(1)).alias("n"))


@query("i02_derived_rules", """
, d AS (SELECT project_id, sum(CASE WHEN width_mm IS NOT NULL THEN door_count * width_mm / 1000 END) AS lm, CAST(sum(door_count) AS DOUBLE) AS n FROM takeoff WHERE category = 'DOOR' GROUP BY 1)
SELECT project_id, 'THRESHOLD' AS tag, 'lm' AS unit, lm AS qty FROM d WHERE lm > 0 UNION ALL SELECT project_id, 'IRONMONGERY', 'nr', n FROM d WHERE n > 0""", ("takeoff",))
def derived_rules(v):
    """Thresholds by the sum of door widths and one set of ironmongery for each door; a rule without a quantity gives no row."""
    width = F.when(F.col("width_mm").isNotNull(), F.col("door_count") * F.col("width_mm") / 1000)
    doors = v("takeoff").where("category = 'DOOR'").groupBy("project_id").agg(F.sum(width).alias("lm"), F.sum("door_count").cast("double").alias("n"))
    rule = lambda tag, unit, qty: F.struct(F.lit(tag).alias("tag"), F.lit(unit).alias("unit"), F.col(qty).alias("qty"))
    return doors.select("project_id", F.explode(F.array(rule("THRESHOLD", "lm", "lm"), rule("IRONMONGERY", "nr", "n"))).alias("r")).select("project_id", "r.*").where("qty > 0")


@query("d18_section_sheet", """
SELECT project_id, category, coalesce(CAST(sum(CASE WHEN NOT is_provisional THEN CAST(qty * rate AS DECIMAL(18,2)) END) AS DOUBLE), 0) AS priced,
  coalesce(CAST(sum(CASE WHEN is_provisional THEN ps_amount END) AS DOUBLE), 0) AS provisional,
  coalesce(CAST(sum(CASE WHEN NOT is_provisional THEN CAST(qty * rate AS DECIMAL(18,2)) END) AS DOUBLE), 0) * 1.05::DOUBLE AS priced_with_vat FROM boq_line GROUP BY GROUPING SETS ((project_id, category), (project_id))""", ("boq_line",))
def section_sheet(v):
    """By section and in all: priced and provisional amounts, VAT on what is priced alone."""
    amount = F.when(~F.col("is_provisional"), (F.col("qty") * F.col("rate")).cast("decimal(18,2)"))
    zero = lambda x: F.coalesce(F.sum(x).cast("double"), F.lit(0.0))
    rows = v("boq_line").groupingSets([[F.col("project_id"), F.col("category")], [F.col("project_id")]], "project_id", "category").agg(
        zero(amount).alias("priced"), zero(F.when(F.col("is_provisional"), F.col("ps_amount"))).alias("provisional"))
    return rows.withColumn("priced_with_vat", F.col("priced") * 1.05)


@query("f08_category_order", """
SELECT project_id, category, row_number() OVER (PARTITION BY project_id ORDER BY CASE category WHEN 'ROOM' THEN 0 WHEN 'DOOR' THEN 1 WHEN 'WINDOW' THEN 2 ELSE 3 END, category) AS place
FROM (SELECT DISTINCT project_id, category FROM takeoff)""", ("takeoff",))
def category_order(v):
    first = F.when(F.col("category") == "ROOM", 0).when(F.col("category") == "DOOR", 1).when(F.col("category") == "WINDOW", 2).otherwise(3)
    place = F.row_number().over(Window.partitionBy("project_id").orderBy(first, "category"))
    return v("takeoff").select("project_id", "category").distinct().select("project_id", "category", place.alias("place"))


@query("e18_latest_version", "SELECT client_id, max(created_at) AS created_at, arg_max(project_id, (created_at, project_id)) AS project_id FROM project GROUP BY 1", ("project",))
def latest_version(v):
    return v("project").groupBy("client_id").agg(F.max(F.struct("created_at", "project_id")).alias("m")).select("client_id", "m.created_at", "m.project_id")


@query("d31_usage", """
SELECT org_id, strftime(created_at, '%Y%m') AS month, count(*) FILTER (status = 'DONE') AS jobs_run, count(*) FILTER (status = 'FAILED') AS jobs_failed FROM job GROUP BY 1, 2""", ("job",))
def usage(v):
    return v("job").groupBy("org_id", F.date_format("created_at", "yyyyMM").alias("month")).agg(
        F.count_if(F.col("status") == "DONE").alias("jobs_run"), F.count_if(F.col("status") == "FAILED").alias("jobs_failed"))
