"""Queries on sheets and their text, layers, validators of drawings, and tables that are written: JSON rows, rates, children, edited bills."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from planwright.functions import sheets as T
from planwright.functions import strings as S
from planwright.operators import edits
from planwright.operators.audit import default_chain
from planwright.plans.registry import query


def _pick(key, *texts):
    """One of the texts by the remainder of the key."""
    return F.element_at(F.array(*[F.lit(t) for t in texts]), (F.col(key) % len(texts) + 1).cast("int"))


@query("h08_schedule_rows", """
, i AS (SELECT *, category = 'DOOR' AND door_count = 0 AS bare FROM takeoff WHERE category IN ('DOOR', 'WINDOW') AND tag IS NOT NULL)
SELECT project_id, item_no, CASE WHEN width_mm IS NOT NULL AND door_count > 0 THEN door_count END AS count, CASE WHEN NOT bare THEN CAST(width_mm AS INT) END AS width_mm,
  CASE WHEN width_mm IS NULL THEN NULL WHEN bare THEN CAST(width_mm AS INT) ELSE CAST(height_mm AS INT) END AS height_mm FROM i""", ("takeoff",))
def schedule_rows(v):
    """Schedule lines, made from the items as a drawing prints them, read back: a header where an item has no width."""
    tag, metres = F.replace(F.col("tag"), F.lit("-"), F.lit("0")), lambda c: (F.col(c) / 1000).cast("decimal(8,2)").cast("string")
    door = F.concat(F.lit("  "), tag, F.lit("    "), F.col("door_count").cast("string"), F.lit("    "), metres("width_mm"), F.lit("    "), metres("height_mm"), F.lit("    3.00    "), tag, F.lit(" 1000 X 3000"))
    window = F.concat(F.lit("  "), tag, F.lit("    "), metres("width_mm"), F.lit("    "), metres("height_mm"), F.lit("    "), F.col("door_count").cast("string"), F.lit("    Sliding Windows    GROUND FLOOR 7"))
    items = v("takeoff").where("category IN ('DOOR', 'WINDOW') AND tag IS NOT NULL")
    header = F.concat(F.lit("  "), tag, F.lit(" D98 W99"))
    is_door = F.col("category") == "DOOR"
    lines = items.select("project_id", "item_no", tag.alias("mark"), is_door.alias("is_door"), F.coalesce(F.when(is_door, door).otherwise(window), header).alias("line"))
    row = F.when(F.col("is_door"), T.schedule_row(F.col("line"), F.col("mark"), "DOOR")).otherwise(T.schedule_row(F.col("line"), F.col("mark"), "WINDOW"))
    return lines.select("project_id", "item_no", row.alias("r")).select("project_id", "item_no", "r.count", "r.width_mm", "r.height_mm")


@query("e14_line_neighbours", r"""
SELECT doc_id, i AS line_no, list_filter(l[greatest(i - 3, 1):i], lambda x: regexp_matches(x, '\S'))[-1] AS previous, list_filter(l[i + 2:i + 5], lambda x: regexp_matches(x, '\S'))[1] AS next
FROM (SELECT doc_id, string_split(text, chr(10)) AS l, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents) WHERE regexp_matches(l[i + 1], '[0-9]')""")
def line_neighbours(v):
    """The filled lines before and after each line with a digit; lines are looked up in their text's own array, without a shuffle."""
    lines = v("documents").where("text IS NOT NULL").select("doc_id", F.split("text", "\n").alias("_lines"))
    found = T.neighbours(F.col("_lines"), kept=lambda x: x.rlike("[0-9]"))
    return lines.select("doc_id", F.explode_outer(found).alias("r")).where(F.col("r").isNotNull()).select("doc_id", "r.line_no", "r.previous", "r.next")


@query("e15_declared_areas", """
SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 1000.0::DOUBLE + p_size WHEN 1 THEN 500.5::DOUBLE WHEN 2 THEN floor(6286 * 0.09290304::DOUBLE * 100 + 0.5) / 100 WHEN 5 THEN 584.0::DOUBLE END AS area FROM part""")
def declared_areas(v):
    n = F.concat(F.lit("BUA: 1,0"), F.lpad(F.col("p_size").cast("string"), 2, "0"), F.lit(" m²"))
    text = F.coalesce(F.when(F.col("p_partkey") % 6 == 0, n), _pick("p_partkey", "", "Built Up Area\nGF\n500.50 sqm\n9 m2", "TOTAL BUILT-UP AREA SQ.FT 6,286\nbua sqft 6,286", "BUA 100 m2\nBUA 200 m2", "area 10 m2", "BUA\n\n\n584 sqm"))
    return v("part").select("p_partkey", T.declared_area(text).alias("area"))


@query("h17_schedule_kinds", "SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'DOOR' WHEN 1 THEN 'WINDOW' WHEN 2 THEN 'WINDOW' WHEN 3 THEN 'WINDOW' WHEN 4 THEN 'DOOR' END AS kind FROM part")
def schedule_kinds(v):
    title = _pick("p_partkey", "Door schedule", "Curtain-Wall types", "CW 01", "Glazing panel", "Window and doors", "Roof plan")
    return v("part").select("p_partkey", T.schedule_kind(title, F.lit(None).cast("string")).alias("kind"))


@query("i14_legend_categories", "SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN 'WALL_FINISH' WHEN 1 THEN 'CEILING' WHEN 2 THEN 'FLOOR_FINISH' WHEN 3 THEN 'FLOOR_FINISH' ELSE 'OTHER' END AS category FROM part")
def legend_categories(v):
    return v("part").select("p_partkey", T.legend_category(_pick("p_size", "WALL", "CEILING", "FLOOR", "EXTERNAL", "JOINERY")).alias("category"))


_PREFIX = """
WITH s AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'MEP' WHEN 1 THEN 'STR' ELSE 'ARCH' END AS found, CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE upper(substr(p_name, 1, 1)) END AS c FROM part),
d AS (SELECT p_partkey, found, CASE WHEN found = 'MEP' AND c NOT IN ('M', 'E', 'P') THEN 'UNKNOWN' WHEN found = 'STR' AND c <> 'S' THEN 'UNKNOWN' ELSE found END AS discipline FROM s)"""


def _disciplines(v):
    found = _pick("p_partkey", "MEP", "STR", "ARCH")
    number = F.when(F.col("p_partkey") % 11 != 0, F.concat(F.lit(" "), "p_name"))
    return v("part").select("p_partkey", found.alias("found"), T.discipline(found, number).alias("discipline"))


@query("b24_disciplines", _PREFIX + "\nSELECT p_partkey, discipline FROM d")
def disciplines(v):
    return _disciplines(v).select("p_partkey", "discipline")


@query("j09_prefix_mismatch", _PREFIX + "\nSELECT p_partkey, 'DISCIPLINE_PREFIX_MISMATCH' AS rule FROM d WHERE found <> discipline")
def prefix_mismatch(v):
    return _disciplines(v).where("found <> discipline").select("p_partkey", F.lit("DISCIPLINE_PREFIX_MISMATCH").alias("rule"))


@query("h15_scales", "SELECT p_partkey, CASE WHEN p_size >= 10 THEN p_size END AS scale FROM part")
def scales(v):
    return v("part").select("p_partkey", T.scale_denominator(F.concat(F.lit("Scale 1 : "), F.col("p_size").cast("string"), F.lit(" @A1"))).alias("scale"))


@query("h05_room_labels", """
SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'code-area' WHEN 1 THEN 'name' ELSE 'unknown' END AS kind, CASE p_partkey % 4 WHEN 0 THEN 'GF-' || p_size END AS code,
  CASE p_partkey % 4 WHEN 0 THEN p_size + 0.5::DOUBLE END AS area, CASE p_partkey % 4 WHEN 1 THEN 'LIVING ROOM' END AS name FROM part""")
def room_labels(v):
    coded = F.concat(F.lit(" gf-"), F.col("p_size").cast("string"), F.lit("  "), F.col("p_size").cast("string"), F.lit(",5 m²"))
    text = F.coalesce(F.when(F.col("p_partkey") % 4 == 0, coded), _pick("p_partkey", "", " LIVING ROOM ", "12 34", "a note that is by far too long to be the name of any room of a house"))
    return v("part").select("p_partkey", T.room_label(text).alias("r")).select("p_partkey", "r.kind", "r.code", "r.area", "r.name")


@query("h04_plain_mtext", "SELECT p_partkey, p_name || ' ' || p_size AS text FROM part")
def plain_mtext(v):
    raw = F.concat(F.lit(r"{\fArial|b0;\H1.5x;\pxqc,3;, "), "p_name", F.lit(r"\P"), F.col("p_size").cast("string"), F.lit("}"))
    return v("part").select("p_partkey", S.plain_mtext(raw).alias("text"))


@query("c02_sheet_document", "SELECT project_id, item_no, s.name AS sheet, o.org_name AS document FROM takeoff t LEFT JOIN supplier_d s ON s.supplier_id = t.sheet_id LEFT JOIN organization o ON o.org_id = s.org_id", ("takeoff", "supplier_d", "organization"))
def sheet_document(v):
    """Items with their sheet and its document; the small sides are joined with each other first."""
    sheets = v("supplier_d").join(v("organization"), "org_id", "left").select(F.col("supplier_id").alias("sheet_id"), F.col("name").alias("sheet"), F.col("org_name").alias("document"))
    return v("takeoff").join(sheets, "sheet_id", "left").select("project_id", "item_no", "sheet", "document")


@query("c16_nearest_codes", """
, l AS (SELECT project_id, item_no AS i, category, description AS name, CASE WHEN finish_code IN ('ST01', 'ST03', 'PR01', 'PR03') THEN finish_code END AS code FROM takeoff),
n AS (SELECT a.project_id, a.name, a.i, arg_min(b.code, (abs(a.i - b.i), b.i)) AS code FROM l a JOIN l b ON a.project_id = b.project_id AND abs(a.i - b.i) <= 6 AND a.i <> b.i AND b.code IS NOT NULL WHERE a.category = 'ROOM' GROUP BY 1, 2, 3)
SELECT project_id, name, CASE WHEN count(DISTINCT code) = 1 THEN min(code) END AS code, count(DISTINCT code) > 1 AS ambiguous FROM n GROUP BY 1, 2""", ("takeoff",))
def nearest_codes(v):
    """The finish code on the line nearest to a room's name, six lines away at most; none if its lines name different ones. A window of bounded width, not a self-join."""
    around = Window.partitionBy("project_id").orderBy("item_no").rangeBetween(-6, 6)
    code = F.when(F.col("finish_code").isin("ST01", "ST03", "PR01", "PR03"), F.col("finish_code"))
    lines = v("takeoff").select("project_id", "item_no", "category", F.col("description").alias("name"), code.alias("code"))
    lines = lines.withColumn("near", F.collect_list(F.struct("item_no", "code")).over(around)).where("category = 'ROOM'")
    other = F.filter("near", lambda x: x["code"].isNotNull() & (x["item_no"] != F.col("item_no")))
    best = F.array_min(F.transform(other, lambda x: F.struct(F.abs(x["item_no"] - F.col("item_no")).alias("d"), x["item_no"].alias("i"), x["code"].alias("code"))))["code"]
    hits = lines.select("project_id", "name", best.alias("code")).where("code IS NOT NULL").groupBy("project_id", "name").agg(F.min("code").alias("low"), F.max("code").alias("high"))
    return hits.select("project_id", "name", F.when(F.col("low") == F.col("high"), F.col("low")).alias("code"), (F.col("low") != F.col("high")).alias("ambiguous"))


@query("d21_layer_counts", """
, c AS (SELECT sheet_id, description, count(*) AS n FROM takeoff GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY sheet_id ORDER BY n DESC, description) AS p FROM c),
t AS (SELECT sheet_id, count(*) FILTER (category = 'ROOM') AS rooms, count(*) FILTER (category = 'DOOR') AS doors, count(*) FILTER (category NOT IN ('ROOM', 'DOOR')) AS others FROM takeoff GROUP BY 1)
SELECT t.sheet_id, rooms, doors, others, string_agg(description || ' x' || n, ', ' ORDER BY p) AS top FROM t JOIN k ON k.sheet_id = t.sheet_id AND p <= 5 GROUP BY 1, 2, 3, 4""", ("takeoff",))
def layer_counts(v):
    """Kinds and the five most frequent names of each layer; both levels combine on the map side, and names are a closed vocabulary."""
    kind = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    named = v("takeoff").groupBy("sheet_id", "description", "category").agg(F.count(F.lit(1)).alias("n"))
    by_name = named.groupBy("sheet_id", "description").agg(F.sum("n").alias("n"), kind(F.col("category") == "ROOM").alias("rooms"), kind(F.col("category") == "DOOR").alias("doors"))
    layers = by_name.groupBy("sheet_id").agg(F.sum("rooms").alias("rooms"), F.sum("doors").alias("doors"), F.sum("n").alias("n"), F.slice(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "description"))), 1, 5).alias("names"))
    top = F.array_join(F.transform("names", lambda x: F.concat(x["description"], F.lit(" x"), (-x["m"]).cast("string"))), ", ")
    return layers.select("sheet_id", "rooms", "doors", (F.col("n") - F.col("rooms") - F.col("doors")).alias("others"), top.alias("top"))


@query("d22_tag_sets", "SELECT project_id, tag, count(*) AS n, string_agg(DISTINCT description, ',' ORDER BY description) AS names, bool_or(unit = 'LS') AS any_ls FROM takeoff WHERE tag IS NOT NULL GROUP BY 1, 2", ("takeoff",))
def tag_sets(v):
    names = F.array_join(F.array_sort(F.collect_set("description")), ",").alias("names")
    return v("takeoff").where("tag IS NOT NULL").groupBy("project_id", "tag").agg(F.count(F.lit(1)).alias("n"), names, F.bool_or(F.col("unit") == "LS").alias("any_ls"))


@query("d35_workbook_totals", """
SELECT project_id, coalesce(CAST(sum(CASE WHEN NOT is_provisional THEN CAST(qty * rate AS DECIMAL(18,2)) END) AS DOUBLE), 0) AS priced_total, count(*) FILTER (NOT is_provisional) AS priced_lines, count(*) AS lines FROM boq_line GROUP BY 1""", ("boq_line",))
def workbook_totals(v):
    amount = F.when(~F.col("is_provisional"), (F.col("qty") * F.col("rate")).cast("decimal(18,2)"))
    return v("boq_line").groupBy("project_id").agg(F.coalesce(F.sum(amount).cast("double"), F.lit(0.0)).alias("priced_total"), F.count_if(~F.col("is_provisional")).alias("priced_lines"), F.count(F.lit(1)).alias("lines"))


@query("a14_json_lines", """
SELECT project_id, item_no, '{"category":"' || category || '","qty":"' || CAST(CAST(qty AS DECIMAL(14,4)) AS VARCHAR) || '","rate":"' || CAST(rate AS VARCHAR) || '","tag":' || CASE WHEN tag IS NULL THEN 'null' ELSE '"' || tag || '"' END || ',"provisional":' || CASE WHEN is_provisional THEN 'true' ELSE 'false' END || '}' AS line FROM boq_line""", ("boq_line",))
def json_lines(v):
    """Bill lines as JSON objects: decimals as strings, nulls written out."""
    line = F.struct("category", F.col("qty").cast("string").alias("qty"), F.col("rate").cast("string").alias("rate"), "tag", F.col("is_provisional").alias("provisional"))
    return v("boq_line").select("project_id", "item_no", F.to_json(line, {"ignoreNullFields": "false"}).alias("line"))


@query("a11_rate_sync", """
, s AS (SELECT DISTINCT 'R' || (p_partkey % 20) AS code, (p_partkey % 20) * 10.0::DOUBLE AS rate FROM part WHERE p_partkey % 20 >= 6), o AS (SELECT code, CAST(rate AS DOUBLE) AS rate FROM rate_library WHERE org_id IS NULL)
SELECT coalesce(s.code, o.code) AS code, s.rate, CASE WHEN o.code IS NULL THEN 'inserted' WHEN s.code IS NULL THEN 'deleted' ELSE 'updated' END AS action FROM s FULL JOIN o ON o.code = s.code""", ("rate_library",))
def rate_sync(v):
    number = F.col("p_partkey") % 20
    seed = v("part").where(number >= 6).select(F.concat(F.lit("R"), number.cast("string")).alias("code"), (number * 10.0).alias("rate")).distinct()
    return edits.sync_by_key(v("rate_library").where("org_id IS NULL").select("code"), seed, ["code"])


@query("k05_replaced_components", """
, n AS (SELECT assembly_id, 'LABOR' AS kind, CAST(10 AS DOUBLE) AS unit_price FROM assembly WHERE assembly_id % 3 = 0)
SELECT assembly_id, kind, CAST(unit_price AS DOUBLE) AS unit_price FROM assembly_component WHERE assembly_id % 3 <> 0 UNION ALL SELECT * FROM n""", ("assembly", "assembly_component"))
def replaced_components(v):
    new = v("assembly").where("assembly_id % 3 = 0").select("assembly_id", F.lit("LABOR").alias("kind"), F.lit(10.0).alias("unit_price"))
    old = v("assembly_component").select("assembly_id", "kind", F.col("unit_price").cast("double").alias("unit_price"))
    return edits.replace_children(old, new, new.select("assembly_id"), ["assembly_id"])


@query("k07_edited_bill", """
, e AS (SELECT project_id, CASE WHEN confidence > 85 THEN qty * 2 ELSE qty END * rate AS a FROM boq_line WHERE tag IS NOT NULL AND NOT is_provisional UNION ALL SELECT project_id, 100 FROM boq_line WHERE category = 'DOOR' AND tag IS NOT NULL)
SELECT project_id, CAST(sum(CAST(a AS DECIMAL(18,2))) AS DOUBLE) AS total, count(*) AS lines FROM e GROUP BY 1""", ("boq_line",))
def edited_bill(v):
    """Totals after lines without a tag are deleted, sure ones doubled and one line of 100 added for each door; provisional lines do not count."""
    lines = v("boq_line").where("NOT is_provisional").select("project_id", "item_no", "tag", "qty", "rate", "confidence")
    patches = lines.where("tag IS NOT NULL AND confidence > 85").select("project_id", "item_no", (F.col("qty") * 2).alias("new_qty"))
    added = v("boq_line").where("category = 'DOOR' AND tag IS NOT NULL").select("project_id", F.lit(1).cast("decimal(14,4)").alias("qty"), F.lit(100).cast("decimal(14,2)").alias("rate"))
    return edits.bill_after(lines, lines.where("tag IS NULL"), patches, added, ["project_id", "item_no"])


@query("j07_legend_sanity", """
SELECT org_id, count(DISTINCT substr(p_name, 1, 4)) AS codes, 'LEGEND_SANITY' AS rule FROM (SELECT p_partkey % 400 AS org_id, p_name FROM part) GROUP BY 1 HAVING codes < 8 OR codes > 25""")
def legend_sanity(v):
    """Legends, here groups of parts with the heads of their names for codes, with fewer or more codes than a legend has."""
    low, high = T.LEGEND_CODES
    legends = v("part").select((F.col("p_partkey") % 400).alias("org_id"), F.substring("p_name", 1, 4).alias("code"))
    return legends.groupBy("org_id").agg(F.count_distinct("code").alias("codes")).where(~F.col("codes").between(low, high)).withColumn("rule", F.lit("LEGEND_SANITY"))


@query("j08_missing_discipline", """
, d AS (SELECT project_id, bool_or(category LIKE 'MEP%') AS mep, bool_or(category = 'SCREED') AS str FROM takeoff GROUP BY 1)
SELECT project_id, 'MEP' AS discipline FROM d WHERE NOT mep UNION ALL SELECT project_id, 'STR' FROM d WHERE NOT str""", ("takeoff",))
def missing_discipline(v):
    """A row for each discipline, services and structure, of which a project has nothing."""
    has = v("takeoff").groupBy("project_id").agg(F.bool_or(F.col("category").startswith("MEP")).alias("mep"), F.bool_or(F.col("category") == "SCREED").alias("str"))
    return has.select("project_id", F.explode(F.array_compact(F.array(F.when(~F.col("mep"), "MEP"), F.when(~F.col("str"), "STR")))).alias("discipline"))


@query("j11_unmapped_finish", """
, r AS (SELECT project_id, item_no FROM takeoff WHERE category = 'ROOM' AND finish_code IS NULL)
SELECT project_id, item_no, 'INFO' AS severity, 1 AS n FROM r UNION ALL SELECT project_id, NULL, 'WARN', count(*) FROM r GROUP BY 1""", ("takeoff",))
def unmapped_finish(v):
    """A note for each room without a finish, and a warning with their number for each project; one pass does both."""
    missing = v("takeoff").where("category = 'ROOM' AND finish_code IS NULL")
    rows = missing.groupingSets([[F.col("project_id"), F.col("item_no")], [F.col("project_id")]], "project_id", "item_no").agg(F.count(F.lit(1)).alias("n"), F.grouping("item_no").alias("g"))
    return rows.select("project_id", "item_no", F.when(F.col("g") == 1, "WARN").otherwise("INFO").alias("severity"), "n")


@query("h43_timed_out", """
SELECT job_id FROM job WHERE status = 'RUNNING' AND started_at < TIMESTAMP '2024-01-05 00:00:00' - INTERVAL '600000' MILLISECOND""", ("job",))
def timed_out(v):
    """Running jobs that began more than ten minutes before a given moment."""
    cutoff = F.timestamp_millis(F.unix_millis(F.lit("2024-01-05 00:00:00").cast("timestamp")) - 600000)
    return v("job").where((F.col("status") == "RUNNING") & (F.col("started_at").cast("timestamp") < cutoff)).select("job_id")


@query("h50_typed_keys", """
SELECT job_id, CASE WHEN job_id % 3 = 0 THEN CAST(json_extract(props, '$.k') AS DOUBLE) END AS k, job_id % 3 = 1 AS is_text FROM job WHERE props IS NOT NULL""", ("job",))
def typed_keys(v):
    """A number of the properties only where it is one: some hold it as text here, some not at all."""
    made = F.when(F.col("job_id") % 3 == 0, F.col("props")).when(F.col("job_id") % 3 == 1, F.regexp_replace("props", r": *(\d+)", ': "$1"')).otherwise("{}")
    value = F.try_parse_json(made)
    kind = F.schema_of_variant(F.try_variant_get(value, "$.k", "variant"))
    return v("job").where("props IS NOT NULL").select("job_id", F.when(kind != "STRING", F.try_variant_get(value, "$.k", "double")).alias("k"), F.coalesce(kind == "STRING", F.lit(False)).alias("is_text"))


@query("h54_known_overrides", """
SELECT DISTINCT project_id, category, CASE category WHEN 'DOOR' THEN 'DOOR=PRICED,NOTE=x' WHEN 'WINDOW' THEN 'NOTE=x,WINDOW=PRICED' ELSE 'NOTE=x' END AS merged, CASE WHEN category IN ('DOOR', 'WINDOW') THEN category || '=PRICED' ELSE '' END AS known FROM takeoff""", ("takeoff",))
def known_overrides(v):
    """Overrides written as JSON: merged with a note, filtered by the keys and values that count, without the note again."""
    raw = F.from_json(F.concat(F.lit('{"'), "category", F.lit('":"PRICED","NOTE":"?"}')), "map<string,string>")
    usable = lambda k, x: k.isin("DOOR", "WINDOW") & x.isin("PRICED", "PENDING")
    known = F.map_filter(raw, usable)
    merged = F.map_concat(known, F.create_map(F.lit("NOTE"), F.lit("x")))
    text = lambda m: F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    back = F.map_filter(merged, lambda k, _: k != "NOTE")
    return v("takeoff").select("project_id", "category").distinct().select("project_id", "category", text(merged).alias("merged"), text(back).alias("known"))


@query("h57_evidence_found", """
SELECT project_id, item_no, CASE WHEN basis = 'ESTIMATED' THEN 'PRIOR' WHEN basis = 'DERIVED' THEN 'DERIVATION' END AS kind, basis = 'ESTIMATED' AS any_assumption, CASE basis WHEN 'MEASURED' THEN 2 WHEN 'DERIVED' THEN 3 ELSE 4 END AS n FROM boq_line""", ("boq_line",))
def evidence_found(v):
    """The first derived or assumed step of a line's evidence, whether any is an assumption, and the steps with a closing one appended; invalid steps are dropped."""
    chain = F.filter(F.array_append(default_chain(F.col("basis")), F.struct(F.lit(None).cast("double").alias("confidence"), F.lit(0.0).alias("weight"), F.lit("BROKEN").alias("kind"))), lambda s: s["confidence"].isNotNull())
    closed = F.array_append(F.transform(chain, lambda s: s["kind"]), F.lit("CLOSED"))
    first = F.get(F.filter(chain, lambda s: s["kind"].isin("DERIVATION", "PRIOR")), F.lit(0))["kind"]
    return v("boq_line").select("project_id", "item_no", first.alias("kind"), F.exists(chain, lambda s: s["kind"] == "ASSUMPTION").alias("any_assumption"), F.size(closed).alias("n"))
