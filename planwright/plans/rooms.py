"""Queries on rooms of several readings, line classes, default provenance, progress, findings and score."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planwright.functions.numbers import chain_confidence
from planwright.operators import audit, classify, reconcile, rooms, spatial
from planwright.plans import audits, bill
from planwright.plans.registry import ORACLE_SQL, query

#: Even sheets stand for what vision saw, odd ones for what the text layer says.
_READINGS = """
, r AS (SELECT *, sheet_id % 2 AS side FROM takeoff WHERE category = 'ROOM'),
n AS (SELECT project_id, description AS name, side, arg_max(qty_ai, item_no) AS area, arg_max(CASE WHEN finish_code IS NULL THEN '' ELSE finish_code END, item_no) AS f FROM r GROUP BY 1, 2, 3),
s AS (SELECT project_id, name, area, nullif(f, '') AS finish FROM n WHERE side = 0), t AS (SELECT project_id, name, area, nullif(f, '') AS finish FROM n WHERE side = 1)"""


def _readings(v) -> list[DataFrame]:
    read = v("takeoff").where("category = 'ROOM'").select("project_id", F.col("description").alias("name"), F.col("item_no").alias("place"), F.col("qty_ai").alias("area"), "finish_code", "sheet_id")
    return [read.where(F.col("sheet_id") % 2 == k).drop("sheet_id") for k in (0, 1)]


@query("c10_room_reconcile", _READINGS + """
SELECT coalesce(s.project_id, t.project_id) AS project_id, coalesce(s.name, t.name) AS name, coalesce(s.area, t.area) AS area, coalesce(s.finish, t.finish) AS finish_code,
  CASE WHEN t.name IS NULL THEN 'VISUAL' WHEN s.name IS NULL THEN 'PARAMETRIC' ELSE 'MEASURED' END AS basis,
  CASE WHEN t.name IS NULL THEN 70 WHEN s.name IS NULL THEN 50 WHEN abs(s.area - t.area) > greatest(s.area, t.area) * 0.02::DOUBLE THEN 60 ELSE 90 END AS confidence,
  t.name IS NOT NULL AND s.name IS NOT NULL AND coalesce(abs(s.area - t.area) > greatest(s.area, t.area) * 0.02::DOUBLE, FALSE) AS mismatch
FROM s FULL JOIN t ON s.project_id = t.project_id AND s.name = t.name""", ("takeoff",))
def room_reconcile(v):
    return rooms.reconcile_rooms(*_readings(v), ["project_id"])


@query("c11_spatial_merge", _READINGS + """
SELECT coalesce(s.project_id, t.project_id) AS project_id, upper(trim(coalesce(s.name, t.name))) AS room, CASE WHEN t.name IS NULL THEN s.area ELSE t.area END AS area, s.finish AS finish_code,
  CASE WHEN t.name IS NULL THEN 'text' WHEN s.name IS NULL THEN 'label' ELSE 'both' END AS source
FROM s FULL JOIN t ON s.project_id = t.project_id AND s.name = t.name""", ("takeoff",))
def spatial_merge(v):
    return rooms.merge_spatial(*_readings(v), ["project_id"])


@query("d30_scorecard", _READINGS + """
SELECT coalesce(s.project_id, t.project_id) AS project_id, count(t.name) AS n_truth, count(s.name) AS n_found, count(*) FILTER (s.name = t.name) AS n_hit,
  count(*) FILTER (s.name = t.name AND abs(s.area - t.area) <= greatest(s.area, t.area) * 0.02::DOUBLE) AS n_within, count(*) FILTER (s.name = t.name AND s.finish = t.finish) AS n_mapped
FROM s FULL JOIN t ON s.project_id = t.project_id AND s.name = t.name GROUP BY 1""", ("takeoff",))
def score(v):
    return rooms.scorecard(*_readings(v), ["project_id"])


@query("c24_carried_rooms", _READINGS + """
SELECT project_id, name, FALSE AS carried FROM s UNION ALL SELECT project_id, name, TRUE FROM t ANTI JOIN s USING (project_id, name)""", ("takeoff",))
def carried_rooms(v):
    """Rooms of a sheet, and those that only its partner sheet knows."""
    known, partner = (side.select("project_id", "name").distinct() for side in _readings(v))
    return known.withColumn("carried", F.lit(False)).unionByName(partner.join(known, ["project_id", "name"], "left_anti").withColumn("carried", F.lit(True)))


_ASSIGNED = """
, r AS (SELECT project_id, item_no, finish_code AS before, part_id % 4 AS e, sheet_id % 3 AS p, sheet_id % 2 AS t FROM takeoff WHERE category = 'ROOM'),
a AS (SELECT *, CASE WHEN before IN ('ST01', 'PR01', 'PR03', 'BATHROOM') THEN before WHEN e = 0 THEN 'ST01' WHEN p = 0 THEN 'PR03' WHEN e = 1 THEN 'PR01' END AS code,
  CASE WHEN before = 'ST01' AND t = 0 THEN 85 WHEN before IN ('ST01', 'PR01', 'PR03', 'BATHROOM') OR e = 0 OR p = 0 THEN 70 WHEN e = 1 THEN 65 END AS confidence FROM r)"""


def _assigned(v) -> DataFrame:
    """Rooms of the synthetic items with a legend of three codes; notes are made from their numbers."""
    entry = lambda code, name, material: F.struct(F.lit(code).alias("code"), F.lit(name).alias("name"), F.lit(material).alias("material"), F.lit(None).cast("string").alias("usage"))
    legend = F.array(entry("ST01", "Porcelain tile", "Porcelain"), entry("PR01", "White marble", None), entry("PR03", "Oak parquet", "oak"))
    note = F.element_at(F.array(*[F.lit(x) for x in ("floor St01 as laid", "white marble floor in the living room", "oak parquet and white marble", "marblehead, PR012")]), (F.col("part_id") % 4 + 1).cast("int"))
    chosen = rooms.assign_finish(F.col("finish_code"), note, F.when(F.col("sheet_id") % 3 == 0, "see pr03."), F.when(F.col("sheet_id") % 2 == 0, "ST01 applies"), legend)
    return v("takeoff").where("category = 'ROOM'").select("project_id", "item_no", F.col("finish_code").alias("before"), chosen.alias("a"))


@query("h11_finish_codes", _ASSIGNED + "\nSELECT project_id, item_no, code, confidence FROM a", ("takeoff",))
def finish_codes(v):
    return _assigned(v).select("project_id", "item_no", "a.code", "a.confidence")


@query("i15_remap_report", _ASSIGNED + """
SELECT project_id, count(*) AS rooms, count(*) FILTER (before IS NULL AND code IS NOT NULL) AS newly, count(*) FILTER (before IS NOT NULL AND before IS DISTINCT FROM code) AS changed,
  count(*) FILTER (before = code) AS unchanged, count(*) FILTER (before IS NULL AND code IS NULL) AS unmapped FROM a GROUP BY 1""", ("takeoff",))
def remap_report(v):
    outcome = rooms.remap_outcome(F.col("before"), F.col("a.code"))
    return _assigned(v).select("project_id", outcome.alias("o")).groupBy("project_id").agg(F.count(F.lit(1)).alias("rooms"), *[F.count_if(F.col("o") == k).alias(k) for k in ("newly", "changed", "unchanged", "unmapped")])


@query("i16_bulk_accept", """
, r AS (SELECT project_id, item_no, finish_code AS f, status = 'APPROVED' AND finish_code IS NOT NULL AS done FROM takeoff WHERE category = 'ROOM')
SELECT project_id, item_no, CASE WHEN done OR f = 'CT09' THEN NULL ELSE f END AS code, CASE WHEN done THEN 'already-confirmed' WHEN f IS NULL THEN 'no-suggestion' WHEN f = 'CT09' THEN 'non-floor-code:CT09' END AS reason FROM r""", ("takeoff",))
def bulk_accept(v):
    confirmed = F.when(F.col("status") == "APPROVED", F.col("finish_code"))
    a = rooms.acceptance(confirmed, F.col("finish_code")).alias("a")
    return v("takeoff").where("category = 'ROOM'").select("project_id", "item_no", a).select("project_id", "item_no", "a.code", "a.reason")


_RATES = [("FF-ST01", 120.0), ("FF-PR01", 0.0), ("SK-PR03", 35.0), ("SKIRTING-LM", 25.0), ("CL-CL02", None), ("JOIN-1", 900.0)]


@query("i07_line_classes", """
, l AS (SELECT project_id, item_no, category, status, CASE WHEN qty_ai % 5 = 0 THEN 0 ELSE qty_ai END AS qty, CASE WHEN category = 'JOINERY' AND sheet_id % 2 = 0 THEN 'JOIN-1' WHEN category = 'OTHER' AND sheet_id % 2 = 0 THEN 'NEW-1' END AS own, finish_code AS f,
  CASE WHEN sheet_id % 3 = 0 THEN 'CL02' WHEN sheet_id % 3 = 1 THEN 'CL03' END AS c FROM takeoff WHERE category <> 'ROOM'),
m AS (SELECT *, status <> 'AI' AS done, status = 'AI' AND qty > 0 AS open, CASE WHEN own = 'JOIN-1' THEN 'JOIN-1' WHEN category = 'PAINT' THEN NULL WHEN category = 'FLOOR_FINISH' AND f IN ('ST01', 'PR01') THEN 'FF-' || f
  WHEN category = 'SKIRTING' THEN CASE WHEN f = 'PR03' THEN 'SK-PR03' ELSE 'SKIRTING-LM' END WHEN category = 'CEILING' AND c = 'CL02' THEN 'CL-CL02' END AS slot FROM l),
k AS (SELECT *, slot IS NOT NULL OR category = 'PAINT' AS found, coalesce(slot NOT IN ('FF-PR01', 'CL-CL02'), category = 'PAINT') AS priced FROM m)
SELECT project_id, item_no, CASE WHEN done OR qty > 0 THEN 'ACTIVE' ELSE 'SUPPRESSED' END AS state, done OR (open AND found AND priced) AS is_priced, CASE WHEN open AND NOT found THEN 'RATE_SLOT_MISSING' WHEN open AND NOT priced THEN 'RATE_MISSING' END AS warning,
  CASE WHEN open THEN slot END AS matched_code,
  CASE WHEN open AND found AND NOT priced THEN slot WHEN open AND NOT found THEN CASE WHEN own IS NOT NULL THEN own WHEN category = 'FLOOR_FINISH' THEN 'FF-' || f WHEN category = 'CEILING' THEN 'CL-' || c END END AS suggested_code FROM k""", ("takeoff",))
def line_classes(v):
    """Items of the synthetic tables against a library of six slots, two of them without a rate; paint is priced by an assembly."""
    even = F.col("sheet_id") % 2 == 0
    lines = v("takeoff").where("category <> 'ROOM'").select(
        "project_id", "item_no", "category", "status", F.when(F.col("qty_ai") % 5 == 0, 0).otherwise(F.col("qty_ai")).alias("qty"),
        F.when((F.col("category") == "JOINERY") & even, "JOIN-1").alias("rate_code"), F.when((F.col("category") == "OTHER") & even, "NEW-1").alias("rate_hint"), F.col("finish_code").alias("floor_code"),
        F.when(F.col("sheet_id") % 3 == 0, "CL02").when(F.col("sheet_id") % 3 == 1, "CL03").alias("ceiling_code"))
    spark = lines.sparkSession
    rates, assemblies = spark.createDataFrame(_RATES, "code string, rate double"), spark.createDataFrame([("PAINT",)], "category string")
    return classify.classify_lines(lines, rates, assemblies).select("project_id", "item_no", "state", "is_priced", "warning", "matched_code", "suggested_code")


@query("i11_default_provenance", """
SELECT project_id, item_no, CASE WHEN tag IS NULL THEN 'MANUAL' ELSE basis END AS source_type, CASE WHEN tag IS NULL OR basis = 'MEASURED' THEN NULL WHEN basis = 'DERIVED' THEN 'formula' ELSE 'ai_reasoning' END AS derivation_type,
  CASE WHEN tag IS NULL THEN 1.0::DOUBLE WHEN basis = 'MEASURED' THEN pow(0.95::DOUBLE, 0.6::DOUBLE) WHEN basis = 'DERIVED' THEN pow(0.95::DOUBLE, 0.6::DOUBLE) * pow(0.9::DOUBLE, 0.5::DOUBLE)
  ELSE pow(0.9::DOUBLE, 0.6::DOUBLE) * pow(0.75::DOUBLE, 0.5::DOUBLE) * pow(0.75::DOUBLE, 0.8::DOUBLE) END AS confidence FROM boq_line""", ("boq_line",))
def default_provenance(v):
    """What old bill lines get: lines without an item were added by hand, others have the default chain of their basis."""
    chain = audit.default_chain(F.col("basis"))
    source, derivation = audit.source_of(F.col("basis"))
    by_hand = F.col("tag").isNull()
    return v("boq_line").select(
        "project_id", "item_no", F.when(by_hand, "MANUAL").otherwise(source).alias("source_type"), F.when(~by_hand, derivation).alias("derivation_type"),
        F.when(by_hand, 1.0).otherwise(chain_confidence(chain)).alias("confidence"))


@query("d34_progress", """
, s AS (SELECT project_id, count(*) AS n, bool_and(floor_material IS NOT NULL AND wall_material IS NOT NULL AND ceiling_material IS NOT NULL) AS whole FROM space GROUP BY 1)
SELECT p.project_id, (1 + (coalesce(n, 0) > 0)::INT + coalesce(whole, FALSE)::INT + (status = 'F')::INT) / 4.0::DOUBLE AS completion,
  CASE WHEN coalesce(n, 0) = 0 THEN 'spaces' WHEN NOT whole THEN 'materials' ELSE 'quotation' END AS step FROM project p LEFT JOIN s ON s.project_id = p.project_id""", ("project", "space"))
def progress(v):
    """Done steps of four, and the first that is not done, or the last one: project, spaces, materials, quotation."""
    whole = F.col("floor_material").isNotNull() & F.col("wall_material").isNotNull() & F.col("ceiling_material").isNotNull()
    spaces = v("space").groupBy("project_id").agg(F.bool_and(whole).alias("whole"))
    both = v("project").select("project_id", "status").join(spaces, "project_id", "left")
    done = [F.col("whole").isNotNull(), F.coalesce("whole", F.lit(False)), F.col("status") == "F"]
    count = reduce(lambda a, b: a + b, [d.cast("int") for d in done], F.lit(1))
    return both.select("project_id", (count / 4).alias("completion"), F.when(~done[0], "spaces").when(~done[1], "materials").otherwise("quotation").alias("step"))


@query("c09_schedule_rows", """
, r AS (SELECT project_id, category, tag, sheet_id % 2 AS side, count(*) * 20 AS n, max(width_mm) AS w, max(height_mm) AS h, max(finish_code) AS f FROM takeoff WHERE category IN ('DOOR', 'WINDOW') AND tag IS NOT NULL GROUP BY ALL),
s AS (SELECT * FROM r WHERE side = 0), t AS (SELECT * FROM r WHERE side = 1),
b AS (SELECT coalesce(s.project_id, t.project_id) AS project_id, coalesce(s.category, t.category) AS category, coalesce(s.tag, t.tag) AS tag, s.n AS sn, t.n AS tn, s.n IS NOT NULL AND t.n IS NOT NULL AS paired, s.n IS NOT NULL AS seen,
  CASE WHEN s.n IS NULL THEN t.w ELSE s.w END AS width_mm, CASE WHEN s.n IS NULL THEN t.h ELSE s.h END AS height_mm, CASE WHEN s.n IS NULL THEN t.f ELSE s.f END AS finish_code,
  CASE WHEN s.n IS NULL OR t.n IS NULL THEN NULL WHEN s.n <> t.n THEN 'count' WHEN (s.w IS NULL) <> (t.w IS NULL) OR abs(s.w - t.w) >= 0.0001 THEN 'width_mm'
    WHEN abs(s.h - t.h) >= 0.0001 THEN 'height_mm' WHEN s.f IS DISTINCT FROM t.f THEN 'finish' END AS mismatch FROM s FULL JOIN t ON s.project_id = t.project_id AND s.category = t.category AND s.tag = t.tag)
SELECT project_id, category, tag, CASE WHEN NOT paired THEN coalesce(sn, tn) WHEN tn <= 50 THEN tn WHEN sn <= 50 THEN sn END AS n, width_mm, height_mm, finish_code, CASE WHEN paired THEN 'MEASURED' WHEN seen THEN 'VISUAL' ELSE 'PARAMETRIC' END AS basis,
  CASE WHEN mismatch IS NOT NULL THEN 60 WHEN paired THEN 90 WHEN seen THEN 70 ELSE 50 END AS confidence, mismatch FROM b""", ("takeoff",))
def schedule_rows(v):
    """Door and window schedules of both readings with counts, sizes and finishes; counts are inflated so that some are beyond belief."""
    tagged = v("takeoff").where("category IN ('DOOR', 'WINDOW') AND tag IS NOT NULL")
    values = [(F.count(F.lit(1)) * 20).alias("n"), *[F.max(c).alias(c) for c in ("width_mm", "height_mm", "finish_code")]]
    sides = [tagged.where(F.col("sheet_id") % 2 == k).groupBy("project_id", "category", "tag").agg(*values) for k in (0, 1)]
    return reconcile.reconcile_schedules(*sides, ["project_id", "category", "tag"])


@query("c13_insert_tags", """
, a AS (SELECT * FROM point WHERE kind = 'AREA'), l AS (SELECT * FROM point WHERE kind = 'NAME'),
m AS (SELECT a.page, a.point_id, arg_min(l.point_id, ((a.x - l.x) * (a.x - l.x) + (a.y - l.y) * (a.y - l.y), l.point_id)) AS label_id FROM a JOIN l ON a.page = l.page AND (a.x - l.x) * (a.x - l.x) + (a.y - l.y) * (a.y - l.y) <= 2500 GROUP BY 1, 2)
SELECT a.page, a.point_id, CASE WHEN label_id IS NULL THEN 'BLOCK-' || a.point_id % 7 ELSE 'T' || label_id END AS tag FROM a LEFT JOIN m ON m.page = a.page AND m.point_id = a.point_id""", ("point",))
def insert_tags(v):
    """Each insert has the tag nearest to it in reach, else the name of its block; the synthetic plan is 50 units for the 1500 mm of a drawing."""
    near = spatial.nearest_within(v("point").where("kind = 'AREA'"), v("point").where("kind = 'NAME'"), 50.0)
    block = F.concat(F.lit("BLOCK-"), (F.col("point_id") % 7).cast("string"))
    return near.select("page", "point_id", F.coalesce(F.concat(F.lit("T"), F.col("label_id").cast("string")), block).alias("tag"))


@query("c14_area_names")
def area_names(v):
    """Areas and names of a page, each name once; no SQL, as each choice depends on those before it."""
    return spatial.one_to_one(v("point").where("kind = 'AREA'"), v("point").where("kind = 'NAME'"), 60.0)


@query("d13_audit_summary", audits.AUDIT + """
, w AS (SELECT b.category, b.basis, a.verdict FROM a JOIN boq_line b ON b.project_id = a.project_id AND b.item_no = a.item_no)
SELECT category, basis, verdict, count(*) AS n FROM w GROUP BY GROUPING SETS ((category, verdict), (basis, verdict), (verdict))""", ("boq_line",))
def audit_summary(v):
    """Verdicts of the audit in all, by section and by basis."""
    sets = [[F.col("category"), F.col("verdict")], [F.col("basis"), F.col("verdict")], [F.col("verdict")]]
    return audits.audited_lines(v).select("category", "basis", "verdict").groupingSets(sets, "category", "basis", "verdict").agg(F.count(F.lit(1)).alias("n"))


_RULES = {"CATEGORY_SANITY": ("j01_category_sanity", audits.category_sanity), "TAG_COVERAGE": ("c17_tag_coverage", audits.coverage), "UNIT_SANITY": ("j03_unit_sanity", bill.unit_sanity),
          "DUPLICATE_TAG": ("e12_occurrences", audits.occurrences), "ROOMS_AREA_RECONCILE": ("d29_area_reconcile", audits.area_reconcile)}


@query("g02_all_findings", "SELECT project_id, rule, count(*) AS n FROM (" + " UNION ALL ".join(f"SELECT project_id, '{rule}' AS rule FROM ({ORACLE_SQL[name]})" for rule, (name, _) in _RULES.items()) + ") GROUP BY 1, 2", dealt=True)
def all_findings(v):
    """Findings of all validators, counted by project and rule."""
    parts = [find(v).select("project_id").groupBy("project_id").agg(F.count(F.lit(1)).alias("n")).withColumn("rule", F.lit(rule)) for rule, (_, find) in _RULES.items()]
    return reduce(DataFrame.unionByName, parts).select("project_id", "rule", "n")
