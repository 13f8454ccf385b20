"""Queries that read drawings: lines and names at their places, phrases in running words, legends in text layers."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from planwright.functions import colours, legend, vision
from planwright.functions import strings as S
from planwright.operators import layers, layout, phrases, pick
from planwright.plans.registry import query
from planwright.session import dealt_by, work_dir
from planwright.sources import text_sink


def page_words(v):
    """Words at places: each sheet's items in a grid, the words of an item's text on one or two lines and its area below.

    Items are dealt by sheet before they are divided: items move and not their words, and the words of a sheet are in one task.
    """
    items = v("takeoff").select(F.col("sheet_id").cast("bigint").alias("page"), (F.col("project_id") * 100 + F.col("item_no")).alias("item"), "description", "qty_ai", "part_id")
    items = dealt_by(items, v("lineitem").count(), "page")
    cell = F.pmod(F.xxhash64("item"), F.lit(10_000))
    x, y = (cell % 100) * 240.0, F.floor(cell / 100) * 90.0
    size = F.col("qty_ai") + (F.col("part_id") % 100) / 100
    area = F.coalesce(size.cast("decimal(20,2)").cast("string"), F.format_string("%.2f", size))  # the latter takes much longer
    words = F.concat(F.split("description", " "), F.array(area, F.lit("m²")))
    made = items.select("page", "item", "part_id", x.alias("x"), y.alias("y"), words.alias("words"))
    placed = made.select("page", "item", "part_id", "x", "y", F.size("words").alias("n"), F.posexplode("words").alias("place", "text"))
    # The last two are the area; a text of three words or more goes on in a second line.
    below = F.when(F.col("place") >= F.col("n") - 2, 26.0).when((F.col("n") > 4) & (F.col("place") >= 2), 11.0).otherwise(0.0)
    left = F.when(F.col("place") >= F.col("n") - 2, F.col("place") - F.col("n") + 2).when((F.col("n") > 4) & (F.col("place") >= 2), F.col("place") - 2).otherwise(F.col("place")) * 52.0
    shake = (F.col("part_id") % 5) * 0.4
    return placed.select(
        "page", (F.col("item") * 100 + F.col("place")).alias("word_no"), "text", (F.col("x") + left).alias("x_min"), (F.col("y") + below + shake).alias("y_min"),
        (F.col("x") + left + F.least(F.length("text") * 5.5, F.lit(47.0))).alias("x_max"), (F.col("y") + below + shake + 10.0).alias("y_max"))


@query("e17_line_tokens", dealt=True)
def line_tokens(v):
    """Words of every sheet put into lines and their neighbours into tokens."""
    return layout.page_tokens(page_words(v), dealt=True).select("page", "line", "token", "text")


@query("c14_sheet_room_areas", dealt=True)
def sheet_room_areas(v):
    """The areas on every sheet with the room name each stands under."""
    return layout.room_areas(page_words(v), dealt=True).select("page", "name", "area_m2", F.round("distance", 6).alias("distance"))


@query("c23_phrases")
def found_phrases(v):
    """Openings of benchmark items, one to four words of them, where they stand in documents."""
    lower = lambda c: F.lower(c)
    texts = v("documents").select("doc_id", F.filter(F.split(F.coalesce("text", F.lit("")), r"\s+"), lambda w: w != "").alias("words"))
    opening = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    named = v("benchmark").select(F.explode(F.array(*[F.array_join(F.slice(opening, 1, n), " ") for n in range(1, phrases.MOST_WORDS + 1)])).alias("name"))
    return phrases.find_phrases(texts, ["doc_id"], named, lower)


@query("c22_located_rooms", """
, w AS (SELECT sheet_id, unnest(string_split(description, ' ')) AS text, (project_id * 100 + item_no) * 100 + unnest(range(len(string_split(description, ' ')))) AS word_no FROM takeoff),
n AS (SELECT *, lead(text) OVER (PARTITION BY sheet_id ORDER BY word_no) AS nxt FROM w),
r AS (SELECT sheet_id, word_no, 1 AS n, text AS p FROM n UNION ALL SELECT sheet_id, word_no, 2, text || ' ' || nxt FROM n WHERE nxt IS NOT NULL),
k AS (SELECT *, trim(regexp_replace(upper(p), '[^A-Z0-9]+', ' ', 'g')) AS key FROM r),
t AS (SELECT DISTINCT description AS name, trim(regexp_replace(upper(description), '[^A-Z0-9]+', ' ', 'g')) AS key FROM takeoff WHERE category = 'ROOM')
SELECT name, sheet_id, word_no, n FROM (SELECT t.name, k.*, row_number() OVER (PARTITION BY t.name ORDER BY sheet_id, word_no, n) AS rn FROM t JOIN k USING (key)) WHERE rn = 1""", ("takeoff",), dealt=True)
def located_rooms(v):
    """The first sheet, and the place there, on which each room's name stands as one or two words."""
    lines = v("takeoff").select("sheet_id", (F.col("project_id") * 100 + F.col("item_no")).alias("item"), "description")
    # Dealt by sheet before they are divided: lines move, not words, and a task sorts no more words of a larger table.
    items = dealt_by(lines, v("lineitem").count(), "sheet_id").select("sheet_id", "item", F.posexplode(F.split("description", " ")).alias("place", "text"))
    words = items.select("sheet_id", (F.col("item") * 100 + F.col("place")).alias("word_no"), "text")
    rooms = v("takeoff").where("category = 'ROOM'").select(F.col("description").alias("name")).distinct().withColumn("key", S.services_key(F.col("name")))
    return phrases.first_sheets(words, rooms, S.services_key)


_SEGMENTS = r"list_filter(list_transform(regexp_split_to_array({0}, '\s{{6,}}'), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: s <> '')"
_DESCRIBES = r"({0} <> '' AND NOT regexp_matches({0}, '^\s*-?\d+(\.\d+)?\s*m[²2]?\s*$', 'i') AND NOT regexp_matches({0}, '^\s*(ground|first|second|third|roof|basement|mezzanine)\s*(floor)?\s*$', 'i') AND NOT regexp_matches({0}, '^\s*(drawing|scale|sheet|revision|project)\b', 'i'))"
_LEGEND = rf"""
, l AS (SELECT @key, unnest(ls) AS line, unnest(range(len(ls))) AS i, ls FROM t),
c AS (SELECT *, list_concat(CASE WHEN regexp_matches(line, '\bBATHROOM\s+FINISHES\b', 'i') THEN ['BATHROOM'] ELSE [] END,
  list_filter(regexp_extract_all(line, '\b([A-Z]{{2}}\d{{2}})\b', 1), lambda x: x NOT IN ('I401', 'I402', 'I403', 'I404', 'A101', 'A102', 'A103', 'A301', 'A302', 'A401', 'A741'))) AS codes FROM l),
u AS (SELECT @key, line, i, ls, unnest(codes) AS code, unnest(range(len(codes))) AS place FROM c),
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY @key, code ORDER BY i, place) AS rn FROM u) WHERE rn = 1),
n AS (SELECT *, list_filter(ls[greatest(i - 3, 1) : i], lambda x: regexp_matches(x, '\S'))[-1] AS prev, list_filter(ls[i + 2 : i + 5], lambda x: regexp_matches(x, '\S'))[1] AS nxt, {_SEGMENTS.format('line')} AS segs FROM f),
s AS (SELECT *, coalesce(list_filter({_SEGMENTS.format('prev')}, lambda x: contains(x, code))[1], regexp_replace(prev, '^\s+|\s+$', '', 'g')) AS above,
  coalesce(list_filter({_SEGMENTS.format('nxt')}, lambda x: contains(x, code))[1], regexp_replace(nxt, '^\s+|\s+$', '', 'g')) AS below, list_position(list_transform(segs, lambda x: contains(x, code)), TRUE) AS at0 FROM n),
d AS (SELECT *, regexp_replace(segs[at0][instr(segs[at0], code) + length(code) :], '^\s+|\s+$', '', 'g') AS inl, array_to_string(list_filter(segs[at0 + 1 :], lambda x: NOT regexp_full_match(x, '[A-Z]{{2}}\d{{2}}') AND {_DESCRIBES.format('x')}), ' ') AS rest FROM s)
SELECT @key, code, CASE WHEN code = 'BATHROOM' THEN 'BATHROOM FINISHES' WHEN length(regexp_replace(above, '[^A-Za-z]', '', 'g')) >= 3 AND length(regexp_replace(above, '[^A-Z]', '', 'g')) / length(regexp_replace(above, '[^A-Za-z]', '', 'g')) >= 0.7 AND {_DESCRIBES.format('above')} THEN above END AS name,
  CASE WHEN code = 'BATHROOM' THEN 'As per Bathroom Drawings' ELSE nullif(trim(CASE WHEN {_DESCRIBES.format('inl')} THEN inl ELSE '' END || ' ' || rest), '') END AS description,
  CASE WHEN code <> 'BATHROOM' AND (regexp_matches(below, '\d+\s*x\s*\d+') OR regexp_matches(below, 'honed|polish|matt|natural|finish|size|colour|color|gloss', 'i')) THEN below END AS detail, i + 1 AS line_no FROM d"""


@query("h10_legend_rows", ", t AS (SELECT project_id, string_split(string_agg(lines, chr(10) ORDER BY item_no), chr(10)) AS ls FROM legend_line GROUP BY 1)" + _LEGEND.replace("@key", "project_id"), ("legend_line",))
def legend_rows(v):
    """Codes of every project's legend lines, the first place of each, with name, description and detail."""
    text = v("legend_line").groupBy("project_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("item_no", "lines"))), lambda x: x["lines"]), "\n").alias("text"))
    return legend.legend_rows(text, ["project_id"])


@query("h10_document_legends", "WITH t AS (SELECT doc_id, regexp_split_to_array(text, '\\r?\\n') AS ls FROM documents WHERE text IS NOT NULL)" + _LEGEND.replace("@key", "doc_id"))
def document_legends(v):
    """The same over the lines of all documents; few of them have codes."""
    return legend.legend_rows(v("documents").select("doc_id", "text"), ["doc_id"])


_PIXELS = """
, c AS (SELECT vec_id, list_transform(range(1, 64), lambda i: CAST(least(greatest(floor((CAST(embedding[i] AS DOUBLE) + 0.3) * 425), 0), 255) AS BIGINT)) AS ch FROM embeddings),
p AS (SELECT vec_id, k, ch[3 * k + 1] AS r, ch[3 * k + 2] AS g, ch[3 * k + 3] AS b FROM (SELECT vec_id, ch, unnest(range(21)) AS k FROM c)),
l AS (SELECT *, (greatest(r, g, b) > 240 AND least(r, g, b) > 230) OR greatest(r, g, b) < 50 OR CASE WHEN greatest(r, g, b) = 0 THEN 0 ELSE (greatest(r, g, b) - least(r, g, b)) / greatest(r, g, b) END < 0.08 AS line FROM p)"""


def patches(v):
    """Vectors as patches of 21 pixels: 63 components as channels."""
    channel = lambda x: F.least(F.greatest(F.floor((x.cast("double") + 0.3) * 425), F.lit(0)), F.lit(255)).cast("int")
    at = lambda k, c: channel(F.get("embedding", 3 * k + c))
    pixels = F.transform(F.sequence(F.lit(0), F.lit(20)), lambda k: F.struct(at(k, 0).alias("r"), at(k, 1).alias("g"), at(k, 2).alias("b")))
    return v("embeddings").select("vec_id", pixels.alias("pixels"))


@query("d24_modal_colours", "WITH " + _PIXELS.lstrip()[2:] + """,
h AS (SELECT vec_id, r // 8 AS x, g // 8 AS y, b // 8 AS z, count(*) AS n, min(k) AS first, sum(r) AS sr, sum(g) AS sg, sum(b) AS sb FROM l WHERE NOT line GROUP BY 1, 2, 3, 4),
m AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY n DESC, first) AS rn, sum(n) OVER (PARTITION BY vec_id) AS kept FROM h) WHERE rn = 1)
SELECT vec_id, CAST(floor(sr / n + 0.5) AS INTEGER) AS r, CAST(floor(sg / n + 0.5) AS INTEGER) AS g, CAST(floor(sb / n + 0.5) AS INTEGER) AS b, round(CAST(kept AS DOUBLE) / 21, 6) AS coverage FROM m""")
def modal_colours(v):
    """The commonest colour of every patch that has one, and how much of the patch is filled."""
    found = patches(v).select("vec_id", colours.modal_colour(F.col("pixels")).alias("m"), F.monotonically_increasing_id().alias("_row")).where(F.col("_row") >= 0).where(F.col("m").isNotNull())
    return found.select("vec_id", "m.r", "m.g", "m.b", F.round("m.coverage", 6).alias("coverage"))


@query("d25_hatched", "WITH " + _PIXELS.lstrip()[2:] + " SELECT vec_id, count(*) FILTER (line) / 21.0::DOUBLE > 0.4 AND count(*) FILTER (line) < 21 AS hatched FROM l GROUP BY 1")
def hatched_patches(v):
    return patches(v).select("vec_id", colours.hatched(F.col("pixels")).alias("hatched"))


_LAYER = """CASE part_id % 9 WHEN 0 THEN 'A-AREA-ROOM' WHEN 1 THEN 'x-Area-Room' WHEN 2 THEN 'LAMI-A-AREA-IDEN' WHEN 3 THEN 'a-wall' WHEN 4 THEN 'A-DOOR-1' WHEN 5 THEN 'DOORS' WHEN 6 THEN 'GLAZING' WHEN 7 THEN 'WALL-DOOR' ELSE '0' END"""


@query("f11_layer_roles", f"""
, y AS (SELECT sheet_id AS drawing_id, {_LAYER} AS layer, count(*) AS entities, count(*) FILTER (category = 'ROOM') AS polys, count(*) FILTER (category IN ('PAINT', 'SCREED')) AS texts, count(*) FILTER (category IN ('DOOR', 'WINDOW')) AS inserts FROM takeoff GROUP BY 1, 2),
s AS (
  SELECT *, 'roomBounds' AS role, CASE WHEN upper(layer) IN ('A-AREA-ROOM', 'A-AREA', 'A-WALL', 'ROOMS', 'ROOM') THEN 100 WHEN contains(upper(layer), 'AREA-ROOM') THEN 90 WHEN contains(upper(layer), 'ROOM') THEN 80 WHEN contains(upper(layer), 'WALL') THEN 70 ELSE 0 END AS score FROM y WHERE polys > 0
  UNION ALL SELECT *, 'roomLabels', CASE WHEN upper(layer) IN ('A-ANNO-ROOM', 'A-ANNO-NOTE', 'A-AREA-IDEN', 'ROOM-NAMES', 'TEXT-ROOMS') THEN 100 WHEN contains(upper(layer), 'AREA-IDEN') THEN 90 WHEN contains(upper(layer), 'IDEN') THEN 20 ELSE 0 END FROM y WHERE texts > 0
  UNION ALL SELECT *, 'doors', CASE WHEN upper(layer) IN ('A-DOOR', 'A-DOOR-SYMB', 'DOORS') THEN 100 WHEN contains(upper(layer), 'DOOR') THEN 90 ELSE 0 END FROM y WHERE inserts > 0
  UNION ALL SELECT *, 'windows', CASE WHEN contains(upper(layer), 'GLAZ') THEN 90 WHEN contains(upper(layer), 'WINDOW') THEN 80 ELSE 0 END FROM y WHERE inserts > 0
  UNION ALL SELECT *, 'walls', CASE WHEN upper(layer) IN ('A-WALL', 'WALLS') THEN 100 WHEN contains(upper(layer), 'WALL') THEN 90 ELSE 0 END FROM y)
SELECT drawing_id, role, CAST(place AS INTEGER) AS place, layer, CAST(score AS INTEGER) AS score FROM (SELECT *, row_number() OVER (PARTITION BY drawing_id, role ORDER BY score DESC, entities DESC, layer) AS place FROM s WHERE score > 0) WHERE place <= 2""", ("takeoff",))
def layer_roles(v):
    """The two best layers of every sheet for each role."""
    count = lambda *c: F.count_if(F.col("category").isin(*c))
    made = v("takeoff").groupBy(F.col("sheet_id").alias("drawing_id"), F.expr(_LAYER).alias("layer")).agg(F.count(F.lit(1)).alias("entities"), count("ROOM").alias("closed_polylines"), count("PAINT", "SCREED").alias("texts"), count("DOOR", "WINDOW").alias("inserts"))
    return layers.suggestions(made, 2)


_DUMP = "concat_ws(' | ', category, coalesce(tag, '—'), description, unit, CAST(CAST(coalesce(qty_final, qty_ai) AS DECIMAL(14,2)) AS {0}))"


@query("a13_text_dump", f"""
, r AS (SELECT project_id, 0 AS block, 0 AS item_no, 'PROJECT ' || project_id || chr(10) || '\\' AS line FROM project UNION ALL SELECT project_id, 1, item_no, {_DUMP.format('VARCHAR')} FROM takeoff)
SELECT row_number() OVER (ORDER BY project_id, block, item_no) - 1 AS place, line FROM r""", ("project", "takeoff"))
def text_dump(v):
    """A dump of all projects, each a head and its items, written as ordered text files and read back in order."""
    heads = v("project").select("project_id", F.lit(0).alias("block"), F.lit(0).cast("long").alias("item_no"), F.concat(F.lit("PROJECT "), F.col("project_id").cast("string"), F.lit("\n\\")).alias("line"))
    items = v("takeoff").select("project_id", F.lit(1).alias("block"), "item_no", F.expr(_DUMP.format("STRING")).alias("line"))
    rows = heads.unionByName(items)
    spark = rows.sparkSession
    root = f"{work_dir(spark)}/dump-{uuid.uuid4().hex}"
    return text_sink.read_lines(spark, text_sink.write_lines(rows, F.col("line"), [F.col(c) for c in ("project_id", "block", "item_no")], root, "dump", 20_000))


@query("e09_best_by_sheet", """
, r AS (SELECT sheet_id, upper(trim(description)) AS name, project_id, item_no, (CASE WHEN part_id % 3 <> 0 THEN 2 ELSE 0 END) + (CASE WHEN finish_code IS NOT NULL THEN 1 ELSE 0 END) AS score FROM takeoff WHERE category = 'ROOM' AND trim(description) <> '')
SELECT sheet_id, name, project_id, item_no, CAST(score AS INTEGER) AS score FROM (SELECT *, row_number() OVER (PARTITION BY sheet_id, name ORDER BY score DESC, project_id, item_no) AS rn FROM r) WHERE rn = 1""", ("takeoff",))
def best_by_sheet(v):
    """Of the readings of a name on a sheet the one with most: an area counts two, a code one, the first of equal ones stays."""
    area, code = F.when(F.col("part_id") % 3 != 0, F.col("qty_ai")), F.col("finish_code")
    score = (F.when(area.isNotNull(), 2).otherwise(0) + F.when(code.isNotNull(), 1).otherwise(0)).alias("score")
    rooms = v("takeoff").where("category = 'ROOM'").select("sheet_id", F.upper(F.trim("description")).alias("name"), "project_id", "item_no", score).where("name <> ''")
    return pick.first_by(rooms, ["sheet_id", "name"], [F.desc("score"), F.col("project_id"), F.col("item_no")]).select("sheet_id", "name", "project_id", "item_no", "score")


@query("h28_crop_windows", """
, p AS (SELECT point_id, x + 600 AS x0, y + 400 AS y0, x + 640 AS x1, y + 410 AS y1, CASE WHEN point_id % 3 = 0 THEN NULL ELSE 50 + point_id % 100 END AS scale FROM point),
m AS (SELECT *, greatest(coalesce(1500 / CAST(scale AS DOUBLE) / 25.4::DOUBLE * 150, 0), 300) AS g FROM p),
s AS (SELECT *, greatest(x1 * 150 / 72 - x0 * 150 / 72 + 2 * g, 1200) AS w0, greatest(y1 * 150 / 72 - y0 * 150 / 72 + 2 * g, 1200) AS h0 FROM m),
a AS (SELECT *, greatest((x0 * 150 / 72 + x1 * 150 / 72) / 2 - w0 / 2, 0) AS ax, greatest((y0 * 150 / 72 + y1 * 150 / 72) / 2 - h0 / 2, 0) AS ay FROM s),
k AS (SELECT point_id, CAST(floor(ax + 0.5) AS BIGINT) AS kx, CAST(floor(ay + 0.5) AS BIGINT) AS ky, CAST(floor(CASE WHEN ax + w0 > 2480 THEN greatest(2480 - ax, 0) ELSE w0 END + 0.5) AS BIGINT) AS kw, CAST(floor(CASE WHEN ay + h0 > 1754 THEN greatest(1754 - ay, 0) ELSE h0 END + 0.5) AS BIGINT) AS kh FROM a)
SELECT point_id, kx, ky, kw, kh, CASE WHEN kw < 1500 THEN CAST(floor(greatest(0, least(2480 - 1500, kx + kw / 2 - 750)) + 0.5) AS BIGINT) ELSE kx END AS bx, CASE WHEN kh < 1500 THEN CAST(floor(greatest(0, least(1754 - 1500, ky + kh / 2 - 750)) + 0.5) AS BIGINT) ELSE ky END AS by_,
  CASE WHEN kw < 1500 THEN 1500 ELSE kw END AS bw, CASE WHEN kh < 1500 THEN 1500 ELSE kh END AS bh FROM k""", ("point",))
def crop_windows(v):
    """Windows around labels at 150 dots an inch on an A3 sheet, for kitchens and for bedrooms."""
    box = F.struct((F.col("x") + 600).alias("x_min"), (F.col("y") + 400).alias("y_min"), (F.col("x") + 640).alias("x_max"), (F.col("y") + 410).alias("y_max"))
    scale = F.when(F.col("point_id") % 3 != 0, 50 + F.col("point_id") % 100).cast("double")
    window = lambda least: vision.crop(box, scale, F.lit(150), F.lit(2480), F.lit(1754), least)
    rows = v("point").select("point_id", window(None).alias("k"), window(vision.BEDROOM_PX).alias("b"))
    return rows.select("point_id", F.col("k.x").alias("kx"), F.col("k.y").alias("ky"), F.col("k.width").alias("kw"), F.col("k.height").alias("kh"), F.col("b.x").alias("bx"), F.col("b.y").alias("by_"), F.col("b.width").alias("bw"), F.col("b.height").alias("bh"))


@query("h29_bounded_answers", """
SELECT item_id, CASE WHEN tag IN ('I', 'L', 'U', 'OPEN-ISLAND') THEN tag ELSE 'OTHER' END AS layout, greatest(coalesce(CASE WHEN rule_rate IS NOT NULL THEN rule_rate - 44 END, 0), 0) AS base_lm,
  CAST(least(60, greatest(0, floor(coalesce(factor_confidence * 100, 50) + 0.5))) AS INTEGER) AS kitchen, CAST(least(55, greatest(0, floor(coalesce(factor_confidence * 100, 40) + 0.5))) AS INTEGER) AS wardrobe FROM drawn_item""", ("drawn_item",))
def bounded_answers(v):
    """Answers of a reading put into bounds: lengths from 0, confidences up to 60 for kitchens and 55 for wardrobes, known layouts."""
    sure = F.col("factor_confidence") * 100
    return v("drawn_item").select(
        "item_id", vision.layout(F.col("tag")).alias("layout"), vision.length(F.col("rule_rate") - 44).alias("base_lm"), vision.confidence(sure, vision.KITCHEN_CAP, 50).alias("kitchen"), vision.confidence(sure, vision.WARDROBE_CAP, 40).alias("wardrobe"))
