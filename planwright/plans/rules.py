"""Queries on rate codes, vanities, evidence texts, orders and the write side (edits, flags, spaces, versions)."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from planwright.operators import edits, rate_codes
from planwright.plans.bill import unit_sanity
from planwright.plans.registry import query


def _place(by: list[str], *order: Column) -> Column:
    return F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long").alias("place")


_CODED = """
, c AS (SELECT project_id, item_no, category, description, unit, CASE category WHEN 'FLOOR_FINISH' THEN 'ff-' || finish_code WHEN 'JOINERY' THEN CASE door_count % 4 WHEN 0 THEN 'VAN-1' WHEN 1 THEN 'KB-1' WHEN 2 THEN 'KW-1' ELSE 'WD-1' END
  WHEN 'WALL_FINISH' THEN CASE WHEN finish_code = 'ST01' THEN 'WF-PAINT' WHEN finish_code = 'PR01' THEN 'WF-WD01' ELSE 'WF-WD03' END WHEN 'OTHER' THEN CASE WHEN finish_code = 'PR03' THEN 'THRESH' END
  WHEN 'DOOR' THEN NULL ELSE tag END AS tag, description || CASE WHEN category = 'DOOR' AND width_mm = 900 THEN ' 900 x 2400' WHEN category = 'DOOR' AND width_mm = 1000 THEN ' 1000 x 3000' ELSE '' END AS said FROM takeoff)"""


@query("h12_rate_codes", _CODED + """
SELECT project_id, item_no, CASE
  WHEN category = 'FLOOR_FINISH' THEN CASE upper(tag) WHEN 'FF-ST01' THEN 'FLR-ST01' WHEN 'FF-PR01' THEN 'FLR-PR01' WHEN 'FF-PR03' THEN 'FLR-PR03' WHEN 'FF-BATHROOM' THEN 'FLR-BATH' WHEN 'FF-ST03' THEN 'EXT-ST03' WHEN 'FF-ST02' THEN 'STAIR-LAND' END
  WHEN category = 'WALL_FINISH' THEN CASE tag WHEN 'WF-PAINT' THEN 'PAINT-INT' WHEN 'WF-WD01' THEN 'WALL-WOODPORC' WHEN 'WF-WD02' THEN 'WALL-MARBPORC' END
  WHEN category = 'JOINERY' THEN CASE WHEN tag LIKE 'VAN-%' THEN 'VANITY' WHEN tag LIKE 'KB-%' THEN 'KIT-BASE' WHEN tag LIKE 'KW-%' THEN 'KIT-WALL' END
  WHEN category = 'DOOR' THEN CASE WHEN said LIKE '%1000%' AND said LIKE '%3000%' THEN 'DOOR-1000x3000-FN01' WHEN said LIKE '%900%' AND said LIKE '%2400%' THEN 'DOOR-900x2400' ELSE 'DOOR-STD-LACQ' END
  WHEN category = 'OTHER' THEN CASE tag WHEN 'THRESH' THEN 'THRESH' WHEN 'STAIR-TREAD' THEN 'STAIR-TREAD' WHEN 'HANDRAIL-MDF' THEN 'HANDRAIL-MDF' END
  WHEN category = 'PAINT' THEN 'PAINT-INT' WHEN category = 'SCREED' THEN 'SCREED-FLR' WHEN category = 'SKIRTING' THEN 'SKIRT-PR01' END AS code FROM c""", ("takeoff",))
def codes(v):
    """Rate code of each item; tags of the synthetic items are made from their finish, as in the domain."""
    category, finish, door = F.col("category"), F.col("finish_code"), F.col("door_count") % 4
    tag = (F.when(category == "FLOOR_FINISH", F.concat(F.lit("ff-"), finish)).when(category == "JOINERY", F.when(door == 0, "VAN-1").when(door == 1, "KB-1").when(door == 2, "KW-1").otherwise("WD-1"))
           .when(category == "WALL_FINISH", F.when(finish == "ST01", "WF-PAINT").when(finish == "PR01", "WF-WD01").otherwise("WF-WD03")).when(category == "OTHER", F.when(finish == "PR03", "THRESH"))
           .when(category == "DOOR", F.lit(None)).otherwise(F.col("tag")))
    said = F.concat("description", F.when((category == "DOOR") & (F.col("width_mm") == 900), " 900 x 2400").when((category == "DOOR") & (F.col("width_mm") == 1000), " 1000 x 3000").otherwise(""))
    return v("takeoff").select("project_id", "item_no", rate_codes.rate_code(category, tag, said, F.col("unit")).alias("code"))


@query("h24_vanities", r"""
, r AS (SELECT project_id, item_no, regexp_matches(description, '\b(BATH|TOILET|POWDER|WC|LAVATORY|RESTROOM)\b', 'i') AS a, coalesce(finish_code = 'BATHROOM', FALSE) AS b FROM takeoff
  WHERE category = 'ROOM' AND NOT regexp_matches(description, '\b(SKYLIGHT|VOID|ABOVE|OVER|UNDER)\b', 'i'))
SELECT project_id, item_no, 1 AS qty, CASE WHEN a AND b THEN 95 ELSE 80 END AS confidence FROM r WHERE a OR b""", ("takeoff",))
def vanities(v):
    sure = rate_codes.vanity(F.col("description"), F.col("finish_code"))
    return v("takeoff").where("category = 'ROOM'").select("project_id", "item_no", F.lit(1).alias("qty"), sure.alias("confidence")).where("confidence IS NOT NULL")


@query("b20_name_classes", r"""
SELECT DISTINCT description, regexp_matches(description, '\b(BATH|TOILET|POWDER|WC|LAVATORY|RESTROOM)\b', 'i') AS bath, regexp_matches(description, '\bSTAIR(CASE)?\b', 'i') AS stair,
  regexp_matches(description, '\b(GARAGE|PROJECTION|VOID|SHAFT|MEP\b|PEDESTRIAN|VEHICULAR|GATE|COVERED\s*GATE|^UP\s*\(?STAIR\b|UP\s*\(STAIR\))', 'i') AS no_finish FROM takeoff""", ("takeoff",))
def name_classes(v):
    name = F.col("description")
    return v("takeoff").select("description").distinct().select(
        "description", name.rlike(rate_codes.BATHROOM).alias("bath"), name.rlike(rate_codes.STAIRCASE).alias("stair"), name.rlike(rate_codes.NO_FINISH).alias("no_finish"))


@query("d19_draft_subtotals", """
SELECT project_id, category, count(*) AS n, coalesce(CAST(sum(CASE WHEN NOT is_provisional THEN CAST(qty * rate AS DECIMAL(18,2)) END) AS DOUBLE), 0) AS subtotal
FROM boq_line WHERE confidence < 60 GROUP BY 1, 2""", ("boq_line",))
def drafts(v):
    """Lines whose evidence calls the rate a placeholder, by section; uncertain lines of the synthetic bill have such evidence."""
    evidence = F.array(F.col("description"), F.when(F.col("confidence") < 60, "Placeholder rate, to be priced"))
    lines = v("boq_line").where(rate_codes.is_placeholder(F.col("basis"), evidence))
    amount = F.when(~F.col("is_provisional"), (F.col("qty") * F.col("rate")).cast("decimal(18,2)"))
    return lines.groupBy("project_id", "category").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(amount).cast("double"), F.lit(0.0)).alias("subtotal"))


@query("h42_durations", """
, d AS (SELECT job_id, CASE WHEN started_at IS NOT NULL THEN (job_id * 7919) % 4000000 END AS ms FROM job)
SELECT job_id, CASE WHEN ms IS NULL THEN '—' WHEN ms < 1000 THEN ms || ' ms' WHEN ms < 60000 THEN (ms // 1000) || 's' ELSE (ms // 60000) || 'm' || lpad(CAST((ms // 1000) % 60 AS VARCHAR), 2, '0') || 's' END AS took FROM d""", ("job",))
def durations(v):
    ms = F.when(F.col("started_at").isNotNull(), F.col("job_id") * 7919 % 4000000).cast("long")
    return v("job").select("job_id", rate_codes.duration_text(ms).alias("took"))


@query("f01_bill_order", """
SELECT project_id, item_no, row_number() OVER (PARTITION BY project_id ORDER BY category, tag NULLS LAST, created_at, item_no) AS place FROM takeoff""", ("takeoff",))
def bill_order(v):
    return v("takeoff").select("project_id", "item_no", _place(["project_id"], F.col("category"), F.asc_nulls_last("tag"), F.col("created_at"), F.col("item_no")))


@query("f03_supplier_order", "SELECT org_id, supplier_id, row_number() OVER (PARTITION BY org_id ORDER BY preferred DESC, name, supplier_id) AS place FROM supplier_d", ("supplier_d",))
def supplier_order(v):
    return v("supplier_d").select("org_id", "supplier_id", _place(["org_id"], F.desc("preferred"), F.col("name"), F.col("supplier_id")))


@query("f07_largest_first", """
SELECT project_id, item_no, row_number() OVER (PARTITION BY project_id ORDER BY CAST(qty * rate AS DECIMAL(18,2)) DESC, item_no) AS place FROM boq_line""", ("boq_line",))
def largest_first(v):
    return v("boq_line").select("project_id", "item_no", _place(["project_id"], (F.col("qty") * F.col("rate")).cast("decimal(18,2)").desc(), F.col("item_no")))


@query("f10_sheet_order", """
SELECT b.project_id, b.item_no, row_number() OVER (PARTITION BY b.project_id ORDER BY t.sheet_id, b.item_no) AS place FROM boq_line b JOIN takeoff t ON t.project_id = b.project_id AND t.item_no = b.item_no""", ("boq_line", "takeoff"))
def sheet_order(v):
    """Lines by the sheet of their item, then by number; both sides share the item's key."""
    sheets = v("takeoff").select("project_id", "item_no", "sheet_id")
    return v("boq_line").join(sheets, ["project_id", "item_no"]).select("project_id", "item_no", _place(["project_id"], F.col("sheet_id"), F.col("item_no")))


@query("e10_best_assignment", """
SELECT project_id, description, arg_max(finish_code, (confidence, -item_no)) AS finish_code, max(confidence) AS confidence FROM takeoff WHERE category = 'ROOM' AND finish_code IS NOT NULL GROUP BY 1, 2""", ("takeoff",))
def best_assignment(v):
    """The finish of each room name over all sheets: the surest, the first on a tie."""
    best = F.max(F.struct("confidence", (-F.col("item_no")).alias("first"), "finish_code")).alias("b")
    return v("takeoff").where("category = 'ROOM' AND finish_code IS NOT NULL").groupBy("project_id", "description").agg(best).select("project_id", "description", "b.finish_code", "b.confidence")


@query("e16_first_filled", """
SELECT project_id, tag, arg_min(item_no, (CASE WHEN width_mm IS NULL THEN 1 ELSE 0 END, item_no)) AS item_no FROM takeoff WHERE tag IS NOT NULL GROUP BY 1, 2""", ("takeoff",))
def first_filled(v):
    """The first row of each tag that has a size, else its first row."""
    first = F.min(F.struct(F.col("width_mm").isNull().alias("blank"), "item_no"))["item_no"].alias("item_no")
    return v("takeoff").where("tag IS NOT NULL").groupBy("project_id", "tag").agg(first)


@query("h51_overflow_note", """
, n AS (SELECT project_id, list_sort(list(DISTINCT description)) AS names FROM takeoff GROUP BY 1)
SELECT project_id, array_to_string(names[1:3], ', ') || CASE WHEN len(names) > 3 THEN ' +' || (len(names) - 3) ELSE '' END AS note FROM n""", ("takeoff",))
def overflow_note(v):
    """The first three names of a project, and how many more there are; names are a closed vocabulary, so their set is small."""
    names = v("takeoff").groupBy("project_id").agg(F.array_sort(F.collect_set("description")).alias("names"))
    more = F.when(F.size("names") > 3, F.concat(F.lit(" +"), (F.size("names") - 3).cast("string"))).otherwise("")
    return names.select("project_id", F.concat(F.array_join(F.slice("names", 1, 3), ", "), more).alias("note"))


@query("h59_codes_of_names", """
SELECT description AS name, string_agg(DISTINCT finish_code, ',' ORDER BY finish_code) AS codes FROM takeoff WHERE finish_code IS NOT NULL GROUP BY 1""", ("takeoff",))
def codes_of_names(v):
    """From the names of each finish code, a map of lists, to the codes of each name."""
    by_code = v("takeoff").where("finish_code IS NOT NULL").groupBy("finish_code").agg(F.collect_set("description").alias("names"))
    return by_code.select("finish_code", F.explode("names").alias("name")).groupBy("name").agg(F.array_join(F.array_sort(F.collect_set("finish_code")), ",").alias("codes"))


@query("i05_wall_features", """
SELECT DISTINCT project_id, 'WF-' || finish_code AS tag, 'm²' AS unit, CAST(NULL AS DOUBLE) AS qty, 50 AS confidence FROM takeoff WHERE category = 'WALL_FINISH' AND finish_code IS NOT NULL""", ("takeoff",))
def wall_features(v):
    """A line without a quantity, to be measured, for each wall finish of the legend."""
    legend = v("takeoff").where("category = 'WALL_FINISH' AND finish_code IS NOT NULL").select("project_id", "finish_code").distinct()
    quantity = F.nullif(F.lit(0.0), F.lit(0.0))
    return legend.select("project_id", F.concat(F.lit("WF-"), "finish_code").alias("tag"), F.lit("m²").alias("unit"), quantity.alias("qty"), F.lit(50).alias("confidence"))


@query("c20_flags_by_item", """
, f AS (SELECT project_id, item_no, 'SIZE' AS rule FROM takeoff WHERE width_mm > 1000 UNION ALL SELECT project_id, item_no, 'UNSURE' FROM takeoff WHERE confidence < 60)
SELECT t.project_id, t.item_no, coalesce(string_agg(rule, ',' ORDER BY rule), '') AS rules FROM takeoff t LEFT JOIN f ON f.project_id = t.project_id AND f.item_no = t.item_no GROUP BY 1, 2""", ("takeoff",))
def flags_by_item(v):
    items = v("takeoff").select("project_id", "item_no", "width_mm", "confidence")
    raised = F.array_compact(F.array(F.when(F.col("width_mm") > 1000, "SIZE"), F.when(F.col("confidence") < 60, "UNSURE")))
    flags = items.select("project_id", "item_no", F.explode(raised).alias("rule")).groupBy("project_id", "item_no").agg(F.array_sort(F.collect_list("rule")).alias("rules"))
    return items.select("project_id", "item_no").join(flags, ["project_id", "item_no"], "left").select("project_id", "item_no", F.coalesce(F.array_join("rules", ","), F.lit("")).alias("rules"))


_EDITS = """
, e AS (SELECT project_id, item_no, qty_final AS new_qty, CASE WHEN basis = 'MEASURED' THEN 'APPROVED' END AS new_status, CASE WHEN confidence > 80 THEN 'PR01' END AS new_finish, confidence > 80 OR confidence < 50 AS sets FROM takeoff WHERE qty_final IS NOT NULL),
m AS (SELECT t.*, e.new_qty, e.new_status, e.new_finish, e.sets, coalesce(new_qty IS NOT NULL AND new_qty IS DISTINCT FROM qty_ai, FALSE) AS q, coalesce(sets AND new_finish IS DISTINCT FROM finish_code, FALSE) AS f,
  CASE WHEN sheet_id % 2 = 0 THEN 'CT01' END AS suggested FROM takeoff t LEFT JOIN e ON e.project_id = t.project_id AND e.item_no = t.item_no)"""


def _edited(v):
    items = v("takeoff").select("project_id", "item_no", "qty_ai", "qty_final", "finish_code", "status", "basis", "confidence", F.when(F.col("sheet_id") % 2 == 0, "CT01").alias("suggested_finish"))
    made = items.where("qty_final IS NOT NULL").select(
        "project_id", "item_no", F.col("qty_final").alias("new_qty"), F.when(F.col("basis") == "MEASURED", "APPROVED").alias("new_status"), F.when(F.col("confidence") > 80, "PR01").alias("new_finish"), F.lit(True).alias("has_qty"), ((F.col("confidence") > 80) | (F.col("confidence") < 50)).alias("has_finish"))
    return edits.apply_edits(items, made, ["project_id", "item_no"])


@query("k06_edited_items", _EDITS + """
SELECT project_id, item_no, coalesce(new_qty, qty_final) AS qty_final, CASE WHEN coalesce(sets, FALSE) THEN new_finish ELSE finish_code END AS finish_code, coalesce(new_status, CASE WHEN q OR f THEN 'EDITED' END, status) AS status FROM m""", ("takeoff",))
def edited_items(v):
    return _edited(v).select("project_id", "item_no", "qty_final", "finish_code", "status")


@query("k06_corrections", _EDITS + """
SELECT project_id, item_no, 'qtyFinal' AS field, CAST(qty_ai AS VARCHAR) AS before, CAST(coalesce(new_qty, qty_final) AS VARCHAR) AS after FROM m WHERE q
UNION ALL SELECT project_id, item_no, 'finish_code', suggested, new_finish FROM m WHERE f""", ("takeoff",))
def correction_log(v):
    return edits.corrections(_edited(v), ["project_id", "item_no"])


@query("k02_flag_upsert", """
, o AS (SELECT project_id, item_no FROM takeoff WHERE category IN ('DOOR', 'WINDOW') AND confidence < 60 AND status <> 'APPROVED'),
n AS (SELECT project_id, item_no FROM takeoff WHERE (category = 'DOOR' AND (width_mm NOT BETWEEN 400 AND 2500 OR height_mm NOT BETWEEN 1800 AND 3500)) OR (category = 'WINDOW' AND (width_mm NOT BETWEEN 300 AND 6000 OR height_mm NOT BETWEEN 300 AND 6000)))
SELECT coalesce(n.project_id, o.project_id) AS project_id, 'UNIT_SANITY' AS rule, coalesce(n.item_no, o.item_no) AS item_no, CASE WHEN n.item_no IS NOT NULL THEN 'ERROR' ELSE 'WARN' END AS severity,
  CASE WHEN n.item_no IS NOT NULL THEN 'size out of range' ELSE 'unsure' END AS message, o.item_no IS NULL AS created FROM o FULL JOIN n ON o.project_id = n.project_id AND o.item_no = n.item_no""", ("takeoff",))
def flag_upsert(v):
    old = v("takeoff").where("category IN ('DOOR', 'WINDOW') AND confidence < 60").select(
        "project_id", F.lit("UNIT_SANITY").alias("rule"), "item_no", F.lit("WARN").alias("severity"), F.lit("unsure").alias("message"), (F.col("status") == "APPROVED").alias("resolved"))
    return edits.upsert_flags(old, unit_sanity(v).withColumn("message", F.lit("size out of range")))


@query("k04_live_prices", "SELECT material_id, supplier_id, price FROM live_price WHERE preferred", ("live_price",))
def live_prices(v):
    """Prices that stay when the suppliers that are not preferred are deleted: their prices go with them."""
    gone = v("supplier_d").where("NOT preferred").select("supplier_id")
    return v("live_price").join(gone, "supplier_id", "left_anti").select("material_id", "supplier_id", "price")


@query("k03_preferred_price", """
SELECT material_id, supplier_id, price, row_number() OVER (PARTITION BY material_id ORDER BY effective_date DESC, supplier_id) = 1 AS preferred FROM live_price""", ("live_price",))
def preferred_price(v):
    """After the newest price of a material is entered as the preferred one: all competing ones are so no longer."""
    newest = F.row_number().over(Window.partitionBy("material_id").orderBy(F.desc("effective_date"), "supplier_id"))
    return v("live_price").select("material_id", "supplier_id", "price", (newest == 1).alias("preferred"))


@query("k09_space_sync", """
, r AS (SELECT project_id, trim(split_part(description, '—', 1)) AS name, item_no, confidence, CASE WHEN sheet_id % 5 <> 0 THEN qty_ai END AS area, status FROM takeoff WHERE category = 'ROOM'),
m AS (SELECT DISTINCT project_id, name FROM r WHERE status = 'EDITED'),
b AS (SELECT *, row_number() OVER (PARTITION BY project_id, name ORDER BY confidence DESC, item_no) AS rn FROM r WHERE area IS NOT NULL)
SELECT b.project_id, b.name, greatest(0.1::DOUBLE, sqrt(area)) AS length, greatest(0.1::DOUBLE, sqrt(area)) AS width, 3.0::DOUBLE AS height
FROM b ANTI JOIN m ON m.project_id = b.project_id AND m.name = b.name WHERE rn = 1""", ("takeoff",))
def space_sync(v):
    rooms = v("takeoff").where("category = 'ROOM'").select("project_id", F.col("description").alias("name"), "item_no", "confidence", F.when(F.col("sheet_id") % 5 != 0, F.col("qty_ai")).alias("area"), "status")
    by_hand = rooms.where("status = 'EDITED'").withColumn("name", F.trim(F.split("name", "—")[0]))
    return edits.sync_spaces(rooms, by_hand)


@query("k08_next_version", """
SELECT project_id, CASE WHEN tag IS NULL THEN NULL ELSE item_no END AS item_no, category, CAST(qty AS DOUBLE) AS qty, tag IS NULL AS carried, 4 AS version FROM boq_line""", ("boq_line",))
def next_version(v):
    """Version 4 after version 3: tagged lines are generated anew, those without an item were added by hand and are carried."""
    lines = v("boq_line").select("project_id", F.when(F.col("tag").isNotNull(), F.col("item_no")).alias("item_no"), "category", F.col("qty").cast("double").alias("qty"))
    return edits.next_version(lines.where("item_no IS NOT NULL"), lines.withColumn("version", F.lit(3))).select("project_id", "item_no", "category", "qty", "carried", "version")


@query("c15_nearest_colour", """
, p AS (SELECT p_partkey, p_partkey * 37 % 256 AS r, p_partkey * 59 % 256 AS g, p_size * 5 % 256 AS b FROM part),
k AS (SELECT * FROM (VALUES ('stone', 200, 190, 170), ('wood', 140, 90, 50), ('tile', 230, 235, 240), ('grass', 60, 140, 70)) t(name, pr, pg, pb))
SELECT p_partkey, arg_min(name, ((r - pr) * (r - pr) + (g - pg) * (g - pg) + (b - pb) * (b - pb), name)) AS colour FROM p, k GROUP BY 1""".replace(", p AS", "WITH p AS", 1))
def nearest_colour(v):
    """The palette's colour with the least squared distance, by an expression over the palette: no join."""
    palette = [("stone", 200, 190, 170), ("wood", 140, 90, 50), ("tile", 230, 235, 240), ("grass", 60, 140, 70)]
    rgb = [F.col("p_partkey") * 37 % 256, F.col("p_partkey") * 59 % 256, F.col("p_size") * 5 % 256]
    square = lambda ref: sum(((c - x) * (c - x) for c, x in zip(rgb, ref, strict=True)), F.lit(0))
    return v("part").select("p_partkey", F.least(*[F.struct(square(ref).alias("d2"), F.lit(name).alias("name")) for name, *ref in palette])["name"].alias("colour"))


@query("c01_nested_bill", """
, s AS (SELECT project_id, category, string_agg(item_no || 'x' || CAST(CAST(qty AS BIGINT) AS VARCHAR), ',' ORDER BY item_no) AS lines FROM boq_line GROUP BY 1, 2)
SELECT project_id, string_agg(category || ':' || lines, ';' ORDER BY category) AS bill FROM s GROUP BY 1""", ("boq_line",))
def nested_bill(v):
    """Each bill as its sections, each with its lines in order: one array of structs a bill, written as text. One shuffle by project does for both levels."""
    line = F.concat(F.col("item_no").cast("string"), F.lit("x"), F.round("qty").cast("long").cast("string")).alias("line")
    sections = v("boq_line").groupBy("project_id", "category").agg(F.array_sort(F.collect_list(F.struct("item_no", line))).alias("lines"))
    text = F.concat("category", F.lit(":"), F.array_join("lines.line", ",")).alias("text")
    bills = sections.groupBy("project_id").agg(F.array_sort(F.collect_list(F.struct("category", text))).alias("sections"))
    return bills.select("project_id", F.array_join("sections.text", ";").alias("bill"))
