"""Queries on the colours of drawings and on spaces from templates."""

from __future__ import annotations

from pyspark.sql import functions as F

from planwright.operators import finish_map, templates
from planwright.operators.costing import space_measures
from planwright.plans.reading import _PIXELS, patches
from planwright.plans.registry import query

NAMES = ["BATH 01", "BATHROOM", "LIVING ROOM", "STAIRCASE", "UP (Stair)", "GARAGE", "POWDER ROOM", "MAID'S ROOM", "ELEVATED TERRACE", None, "MEP SHAFT"]
CODES = ["st01", "ST02", "ST03", "PR01", "PR03", "CT09", "FN01"]
#: A code of every legend that stands on no drawing, and one that has no colour of its own either.
UNSEEN = ["LS01", "XX99"]

_MODAL = """
, h AS (SELECT vec_id, r // 8 AS x, g // 8 AS y, b // 8 AS z, count(*) AS n, min(k) AS first, sum(r) AS sr, sum(g) AS sg, sum(b) AS sb FROM l WHERE NOT line GROUP BY 1, 2, 3, 4),
m AS (SELECT vec_id, CAST(floor(sr / n + 0.5) AS INTEGER) AS r, CAST(floor(sg / n + 0.5) AS INTEGER) AS g, CAST(floor(sb / n + 0.5) AS INTEGER) AS b, CAST(kept AS DOUBLE) / 21 AS coverage
  FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY n DESC, first) AS rn, sum(n) OVER (PARTITION BY vec_id) AS kept FROM h) WHERE rn = 1),
legend AS (SELECT label AS drawing, vec_id % 7 AS place, min(vec_id) AS vec_id FROM embeddings WHERE vec_id IS NOT NULL GROUP BY 1, 2),
coded AS (SELECT drawing, place, ['ST01', 'ST02', 'ST03', 'PR01', 'PR03', 'CT09', 'FN01'][place + 1] AS code, vec_id FROM legend
  UNION ALL SELECT DISTINCT label, 7, 'LS01', CAST(NULL AS BIGINT) FROM embeddings UNION ALL SELECT DISTINCT label, 8, 'XX99', CAST(NULL AS BIGINT) FROM embeddings),
canon AS (SELECT * FROM (VALUES ('ST01', 130, 170, 220), ('ST02', 140, 200, 130), ('ST03', 240, 180, 160), ('PR01', 190, 140, 200), ('PR03', 170, 130, 90), ('LS01', 170, 170, 90)) t(code, r, g, b)),
palette AS (SELECT drawing, place, coded.code, coalesce(m.coverage, 0) > 0.2 AS from_document, CASE WHEN coalesce(m.coverage, 0) > 0.2 THEN m.r ELSE canon.r END AS r,
  CASE WHEN coalesce(m.coverage, 0) > 0.2 THEN m.g ELSE canon.g END AS g, CASE WHEN coalesce(m.coverage, 0) > 0.2 THEN m.b ELSE canon.b END AS b
  FROM coded LEFT JOIN m USING (vec_id) LEFT JOIN canon ON canon.code = coded.code WHERE coalesce(m.coverage, 0) > 0.2 OR canon.code IS NOT NULL)"""


def legends(v):
    """Legends of the drawings that labels name: the swatch of each code is the patch with the smallest id of those dealt to its place."""
    placed = patches(v).join(v("embeddings").select("vec_id", F.col("label").alias("drawing")), "vec_id").where(F.col("vec_id").isNotNull())
    place = F.pmod("vec_id", F.lit(7)).cast("int")
    seen = placed.groupBy("drawing", place.alias("place")).agg(F.min_by("pixels", "vec_id").alias("swatch"))
    seen = seen.select("drawing", "place", F.get(F.array(*[F.lit(c) for c in CODES]), F.col("place")).alias("code"), "swatch")
    unseen = F.array(*[F.struct(F.lit(7 + k).alias("place"), F.lit(c).alias("code")) for k, c in enumerate(UNSEEN)])
    more = v("embeddings").select(F.col("label").alias("drawing")).distinct().select("drawing", F.inline(unseen))
    return seen.unionByName(more, allowMissingColumns=True)


@query("i18_palettes", "WITH " + _PIXELS.lstrip()[2:] + _MODAL + " SELECT * FROM palette")
def document_palettes(v):
    """Colours of every drawing's legend codes, sampled or canonical."""
    return finish_map.palettes(legends(v)).select("drawing", F.inline("palette"))


@query("i17_room_finishes", "WITH " + _PIXELS.lstrip()[2:] + _MODAL + r""",
room AS (SELECT e.vec_id, label AS drawing, ['BATH 01', 'BATHROOM', 'LIVING ROOM', 'STAIRCASE', 'UP (Stair)', 'GARAGE', 'POWDER ROOM', 'MAID''S ROOM', 'ELEVATED TERRACE', NULL, 'MEP SHAFT'][vec_id % 11 + 1] AS name,
    hatched, m.r, m.g, m.b, coalesce(m.coverage, 0) AS coverage
  FROM embeddings e LEFT JOIN m USING (vec_id) LEFT JOIN (SELECT vec_id, count(*) FILTER (line) / 21.0::DOUBLE > 0.4 AND count(*) FILTER (line) < 21 AS hatched FROM l GROUP BY 1) USING (vec_id)),
near AS (SELECT vec_id, min(d2) AS d2, arg_min(code, (d2, place)) AS code FROM (SELECT vec_id, place, code, (p.r - room.r) * (p.r - room.r) + (p.g - room.g) * (p.g - room.g) + (p.b - room.b) * (p.b - room.b) AS d2
  FROM room JOIN palette p ON p.drawing IS NOT DISTINCT FROM room.drawing WHERE room.r IS NOT NULL) GROUP BY 1),
step AS (SELECT room.*, near.d2, near.code, CASE WHEN name IN ('GARAGE', 'MEP SHAFT', 'UP (Stair)') THEN 1 WHEN name = 'STAIRCASE' THEN 2 WHEN hatched AND name IN ('BATH 01', 'POWDER ROOM') THEN 3
    WHEN hatched AND coverage > 0.05 AND d2 < 12000 THEN 4 WHEN hatched THEN 5 WHEN name IN ('BATH 01', 'POWDER ROOM') THEN 6 WHEN coverage < 0.05 OR d2 IS NULL THEN 7 WHEN d2 > 25000 THEN 8 ELSE 9 END AS k FROM room LEFT JOIN near USING (vec_id))
SELECT drawing, vec_id, CASE WHEN k = 2 THEN 'ST02' WHEN k IN (3, 6) THEN 'BATHROOM' WHEN k IN (4, 8, 9) THEN code END AS finish_code,
  CASE k WHEN 2 THEN 85 WHEN 3 THEN 85 WHEN 4 THEN 65 WHEN 6 THEN 80 WHEN 8 THEN 20 WHEN 9 THEN CAST(floor(greatest(30, 90 - CAST(d2 AS DOUBLE) / 12500 * 30) + 0.5) AS INTEGER) ELSE 0 END AS confidence,
  CASE WHEN k IN (1, 7) THEN 'no-color' WHEN k IN (3, 6) THEN 'hatched-bathroom' WHEN k IN (5, 8) THEN 'far-from-palette' ELSE 'sampled' END AS reason,
  CASE WHEN k > 2 THEN r END AS r, CASE WHEN k > 2 THEN g END AS g, CASE WHEN k > 2 THEN b END AS b FROM step""")
def room_finishes(v):
    """Every patch as the room below a label, with a name dealt by its id."""
    name = F.get(F.array(*[F.lit(n) for n in NAMES]), F.pmod("vec_id", F.lit(len(NAMES))).cast("int"))
    rooms = patches(v).join(v("embeddings").select("vec_id", F.col("label").alias("drawing")), "vec_id").select("vec_id", "drawing", name.alias("name"), "pixels")
    return finish_map.room_finishes(rooms, finish_map.palettes(legends(v)), "vec_id")


@query("i17_sample_windows", """
WITH p AS (SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 72 WHEN 1 THEN 150 ELSE 220 END AS dpi, p_retailprice AS x0, p_size * 10.5 AS y0, p_retailprice + 5 + p_size % 7 * 3.25 AS x1, p_size * 10.5 + 8 + p_size % 4 AS y1 FROM part),
q AS (SELECT p_partkey, floor((x1 - x0) * dpi / 72 + 0.5) AS w, floor((y1 - y0) * dpi / 72 + 0.5) AS h, floor(x0 * dpi / 72 + 0.5) AS l, floor(y0 * dpi / 72 + 0.5) AS t, floor(y1 * dpi / 72 + 0.5) AS u, floor((x0 + x1) / 2 * dpi / 72 + 0.5) AS c FROM p)
SELECT p_partkey, CAST(l - greatest(w, 2 * h) - floor(h * 0.5 + 0.5) AS BIGINT) AS swatch_x0, CAST(l - floor(h * 0.5 + 0.5) AS BIGINT) AS swatch_x1, CAST(t - floor(h * 0.3 + 0.5) AS BIGINT) AS swatch_y0, CAST(u + floor(h * 0.3 + 0.5) AS BIGINT) AS swatch_y1,
  CAST(c - greatest(w, 3 * h) AS BIGINT) AS room_x0, CAST(c + greatest(w, 3 * h) AS BIGINT) AS room_x1, CAST(u AS BIGINT) AS room_y0, CAST(u + 2 * floor(h * 1.5 + 0.5) AS BIGINT) AS room_y1 FROM q""")
def sample_windows(v):
    """Where the swatch of a code and the fill of a room are looked for, from the box of the word."""
    x, y = F.col("p_retailprice").cast("double"), F.col("p_size") * 10.5
    box = F.struct(x.alias("x_min"), y.alias("y_min"), (x + 5 + F.col("p_size") % 7 * 3.25).alias("x_max"), (y + 8 + F.col("p_size") % 4).alias("y_max"))
    dpi = F.when(F.col("p_size") % 3 == 0, 72).when(F.col("p_size") % 3 == 1, 150).otherwise(220)
    both = v("part").select("p_partkey", finish_map.swatch_window(box, dpi).alias("swatch"), finish_map.room_window(box, dpi).alias("room"))
    return both.select("p_partkey", *[F.col(f"{w}.{k}").alias(f"{w}_{k}") for w in ("swatch", "room") for k in ("x0", "x1", "y0", "y1")])


@query("i13_template_spaces", """
SELECT c_custkey, template_id, length_m, width_m, height_m, floor_category, wall_category, ceiling_category, template_id || '.name' AS name_key,
  coalesce(length_m * width_m, 0) AS floor_area, coalesce(2 * (length_m + width_m), 0) AS perimeter, coalesce(2 * (length_m + width_m) * height_m, 0) AS wall_area
FROM (SELECT c_custkey, CASE c_nationkey % 9 WHEN 0 THEN 'bedroom-small' WHEN 1 THEN 'bedroom-medium' WHEN 2 THEN 'bedroom-luxury' WHEN 3 THEN 'living-room' WHEN 4 THEN 'bathroom'
  WHEN 5 THEN 'office' WHEN 6 THEN 'retail' END AS id FROM customer) LEFT JOIN (VALUES ('bedroom-small', 3.2::DOUBLE, 2.8::DOUBLE, 2.7::DOUBLE, 'tiles', 'paint', 'paint'),
  ('bedroom-medium', 4, 3.6, 2.8, 'tiles', 'paint', 'paint'), ('bedroom-luxury', 5.5, 4.5, 3, 'marble', 'cladding', 'gypsum'), ('living-room', 6, 4.5, 2.9, 'marble', 'paint', 'gypsum'),
  ('bathroom', 2.5, 1.8, 2.6, 'tiles', 'tiles', 'paint'), ('office', 4.2, 3.5, 2.8, 'tiles', 'paint', 'gypsum'), ('retail', 8, 6, 3.4, 'marble', 'cladding', 'gypsum'))
  t(template_id, length_m, width_m, height_m, floor_category, wall_category, ceiling_category) ON id = template_id""")
def template_spaces(v):
    """The space that each customer's template gives, with its measures; none for a template that does not exist."""
    ids = [t[0] for t in templates.TEMPLATES]
    chosen = F.coalesce(F.get(F.array(*[F.lit(i) for i in ids]), F.col("c_nationkey") % 9), F.lit("none"))
    out = space_measures(templates.from_templates(v("customer").select("c_custkey", chosen.alias("template_id"))))
    known = F.when(F.col("length_m").isNotNull(), F.col("template_id")).alias("template_id")
    return out.select("c_custkey", known, "length_m", "width_m", "height_m", "floor_category", "wall_category", "ceiling_category", "name_key", "floor_area", "perimeter", "wall_area")
