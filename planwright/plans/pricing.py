"""A bill priced end to end, and the quantities that rules derive."""

from __future__ import annotations

from pyspark.sql import functions as F

from planwright.operators import bill, rules
from planwright.operators.pricing import price_bill
from planwright.plans.bill import _NO_TOOLS, _UNIT
from planwright.plans.registry import query

_CODE = """coalesce(
    CASE WHEN category = 'FLOOR_FINISH' THEN CASE upper(coalesce(tag, '')) WHEN 'FF-ST01' THEN 'FLR-ST01' WHEN 'FF-PR01' THEN 'FLR-PR01' WHEN 'FF-PR03' THEN 'FLR-PR03' WHEN 'FF-BATHROOM' THEN 'FLR-BATH' WHEN 'FF-ST03' THEN 'EXT-ST03' WHEN 'FF-ST02' THEN 'STAIR-LAND' END
      WHEN category = 'WALL_FINISH' THEN CASE upper(coalesce(tag, '')) WHEN 'WF-PAINT' THEN 'PAINT-INT' WHEN 'WF-WD01' THEN 'WALL-WOODPORC' WHEN 'WF-WD02' THEN 'WALL-MARBPORC' END
      WHEN category = 'CEILING' THEN CASE upper(coalesce(tag, '')) WHEN 'CL-CL02' THEN 'CEIL-CL02' WHEN 'CL-CL03' THEN 'CEIL-CL03' WHEN 'CL-CL01-EXT' THEN 'CEIL-CL01-EXT' END
      WHEN category = 'OTHER' THEN CASE upper(coalesce(tag, '')) WHEN 'STAIR-TREAD' THEN 'STAIR-TREAD' WHEN 'THRESH' THEN 'THRESH' WHEN 'HANDRAIL-MDF' THEN 'HANDRAIL-MDF' END
      WHEN category = 'JOINERY' THEN CASE WHEN upper(coalesce(tag, '')) LIKE 'VAN-%' THEN 'VANITY' WHEN upper(coalesce(tag, '')) LIKE 'KB-%' THEN 'KIT-BASE' WHEN upper(coalesce(tag, '')) LIKE 'KW-%' THEN 'KIT-WALL' END END,
    CASE WHEN category = 'DOOR' THEN CASE WHEN contains(description, '1000') AND contains(description, '3000') THEN 'DOOR-1000x3000-FN01' WHEN contains(description, '900') AND contains(description, '2400') THEN 'DOOR-900x2400' ELSE 'DOOR-STD-LACQ' END
      WHEN category = 'EXTERNAL' AND unit = 'm²' THEN 'EXT-ST03' WHEN category = 'PAINT' THEN 'PAINT-INT' WHEN category = 'SCREED' THEN 'SCREED-FLR' WHEN category = 'SKIRTING' THEN 'SKIRT-PR01' END)"""
_PRICED = _NO_TOOLS + f"""
, l AS (SELECT *, {_UNIT.format('unit')} AS u, {_CODE} AS code, coalesce(category = 'WALL_FINISH' AND tag LIKE 'WF-%' AND tag <> 'WF-PAINT', FALSE) AS feature FROM bill_item),
a AS (SELECT org_assembly.*, {_UNIT.format('output_unit')} AS u, round(coalesce(unit_cost, 0), 6) AS cost, string_split(finish_list, ',') AS finishes FROM org_assembly LEFT JOIN cost USING (assembly_id)),
k AS (SELECT DISTINCT org_id, category, u, finish_code, CASE WHEN category = 'CEILING' THEN 'CEILING' WHEN category IN ('WALL_FINISH', 'PAINT', 'PLASTER') THEN 'WALL' WHEN category IN ('FLOOR_FINISH', 'SCREED') THEN 'FLOOR' END AS surface FROM l WHERE NOT feature),
own AS (SELECT k.org_id, category, k.u, k.finish_code, arg_min(assembly_id, (sort_order, assembly_id)) AS own_id, arg_min(cost, (sort_order, assembly_id)) AS own_cost FROM k JOIN a ON a.org_id = k.org_id AND a.u = k.u AND takeoff_category = category
  AND (finishes IS NULL OR list_contains(finishes, k.finish_code)) GROUP BY ALL),
loose AS (SELECT k.org_id, category, k.u, min(assembly_id) AS loose_id, min(cost) AS loose_cost FROM (SELECT DISTINCT org_id, category, u, surface FROM k) k JOIN a ON a.org_id = k.org_id AND a.u = k.u AND takeoff_category IS NULL AND applies_to IN ('GENERIC', surface)
  WHERE surface IS NOT NULL GROUP BY ALL HAVING count(*) = 1),
r AS (SELECT l.*, own_id, own_cost, loose_id, loose_cost, o.code IS NOT NULL AS mine, CASE WHEN o.code IS NOT NULL THEN CASE WHEN {_UNIT.format('o.unit')} = l.u THEN o.rate END WHEN {_UNIT.format('g.unit')} = l.u THEN g.rate END AS lib
  FROM l LEFT JOIN own ON NOT feature AND own.org_id = l.org_id AND own.category = l.category AND own.u = l.u AND own.finish_code IS NOT DISTINCT FROM l.finish_code
  LEFT JOIN loose ON NOT feature AND loose.org_id = l.org_id AND loose.category = l.category AND loose.u = l.u
  LEFT JOIN code_rate o ON o.org_id = l.org_id AND o.code = l.code LEFT JOIN code_rate g ON g.org_id IS NULL AND g.code = l.code),
s AS (SELECT project_id, item_no, category, qty, item_id, is_provisional AS was, ps_amount AS typed, coalesce(source LIKE 'mep-rule:%', FALSE) AS ruled, source AS src,
  CASE WHEN source LIKE 'mep-rule:%' THEN rate ELSE coalesce(own_cost, loose_cost, lib) END AS found,
  CASE WHEN source LIKE 'mep-rule:%' THEN source WHEN own_id IS NOT NULL THEN 'assembly:' || own_id WHEN loose_id IS NOT NULL THEN 'assembly:' || loose_id WHEN lib IS NOT NULL THEN 'rate-library:' || CASE WHEN mine THEN 'org' ELSE 'global' END || ':' || code ELSE 'provisional-sum' END AS source FROM r),
p AS (SELECT project_id, item_no, category, source, round(found, 4) AS rate, found IS NULL AS is_provisional, floor(coalesce(qty * found, 0) * 100 + 0.5) / 100 AS amount, CASE WHEN NOT ruled AND item_id IS NULL AND was THEN typed END AS ps_amount FROM s)"""
_VIEWS = ("bill_item", "org_assembly", "assembly_component", "code_rate")


def priced(v):
    assemblies = v("org_assembly").withColumn("finish_codes", F.split("finish_list", ","))
    return price_bill(v("bill_item"), assemblies, v("assembly_component"), v("code_rate"))


@query("c07_priced_bill", _PRICED + " SELECT project_id, item_no, source, rate, is_provisional, amount, ps_amount FROM p", _VIEWS)
def priced_bill(v):
    """Every bill line priced by the whole waterfall: services rules, assemblies, surfaces, rate codes, or a provisional sum."""
    return priced(v).select("project_id", "item_no", "source", F.round("rate", 4).alias("rate"), "is_provisional", "amount", "ps_amount")


@query("d08_priced_sections", _PRICED + """
SELECT project_id, category, CAST(sum(CAST(amount AS DECIMAL(18,2))) AS DOUBLE) AS subtotal, coalesce(CAST(sum(CAST(ps_amount AS DECIMAL(18,2))) AS DOUBLE), 0) AS provisional, count(*) FILTER (NOT is_provisional) AS n_priced, count(*) FILTER (is_provisional) AS n_provisional FROM p GROUP BY 1, 2""", _VIEWS)
def priced_sections(v):
    """Subtotals of the priced bill; provisional lines count with the sums typed by hand alone."""
    money = lambda c: F.coalesce(F.sum(F.col(c).cast("decimal(18,2)")).cast("double"), F.lit(0.0))
    return priced(v).groupBy("project_id", "category").agg(money("amount").alias("subtotal"), money("ps_amount").alias("provisional"), F.count_if(~F.col("is_provisional")).alias("n_priced"), F.count_if("is_provisional").alias("n_provisional"))


@query("i02_rule_registry", r"""
, m AS (SELECT project_id, sum(CASE WHEN st THEN CASE WHEN width_mm > 0 THEN door_count * width_mm / 1000 ELSE nullif(door_count * height_mm / 1000, 0) END END) AS stair, sum(CASE WHEN st AND finish_code IS NOT NULL THEN coalesce(qty_final, qty_ai) END) AS landing,
    sum(CASE WHEN category = 'DOOR' THEN door_count * width_mm / 1000 END) AS width, CAST(sum(CASE WHEN category = 'DOOR' THEN door_count END) AS DOUBLE) AS doors, count(*) FILTER (category LIKE 'MEP%') AS served
  FROM (SELECT *, category = 'ROOM' AND regexp_matches(description, '\bSTAIRCASE\b', 'i') AS st FROM takeoff) GROUP BY 1),
two AS (SELECT *, printf('%.2f', floor(stair * 100 + 0.5) / 100) AS st2, printf('%.2f', floor(landing * 100 + 0.5) / 100) AS la2, printf('%.2f', floor(width * 100 + 0.5) / 100) AS wi2, CAST(CAST(floor(doors) AS BIGINT) AS VARCHAR) AS do0 FROM m)
SELECT project_id, 'sprint1.stair-tread' AS rule_id, 'STAIR-TREAD' AS tag, 'lm' AS unit, stair AS qty, 'Σ stair tread length = ' || st2 || ' lm' AS reasoning FROM two WHERE stair > 0
UNION ALL SELECT project_id, 'sprint1.stair-landing', 'STAIR-LAND', 'm²', landing, 'Σ landing area = ' || la2 || ' m²' FROM two WHERE landing > 0
UNION ALL SELECT project_id, 'sprint1.stair-handrail', 'STAIR-HANDRAIL', 'rm', stair, 'Handrail length = stair length = ' || st2 || ' rm' FROM two WHERE stair > 0
UNION ALL SELECT project_id, 'sprint1.door-threshold', 'THRESHOLD', 'lm', width, 'Σ door widths = ' || wi2 || ' lm (across ' || do0 || CASE WHEN doors = 1 THEN ' door)' ELSE ' doors)' END FROM two WHERE width > 0
UNION ALL SELECT project_id, 'sprint1.door-ironmongery', 'IRONMONGERY', 'nr', doors, '1 ironmongery set per door × ' || do0 || ' doors' FROM two WHERE doors > 0
UNION ALL SELECT project_id, 'added.door-stops', 'DOOR-STOP', 'No', greatest(1, floor(doors * 0.4 + 0.5)), 'stops' FROM two WHERE doors * 0.4 > 0 AND served > 0""", ("takeoff",))
def rule_registry(v):
    """The seed rules and one more, which is a row alone, over all items; door stops need services items in the project."""
    items = v("takeoff")
    more = ("added.door-stops", "DOOR_COUNT", 0.4, "OTHER", "DOOR-STOP", "No", "STOP-NR", "Door stop", "stops", "SERVICES_ITEMS")
    return rules.run_rules(items, rules.registry(items.sparkSession, [*rules.RULES, more])).select("project_id", "rule_id", "tag", "unit", "qty", "reasoning")


@query("i08_full_bill", f"""
, asm AS (SELECT DISTINCT takeoff_category AS category FROM org_assembly WHERE takeoff_category IS NOT NULL),
s0 AS (SELECT * FROM drawn_item WHERE category <> 'ROOM' AND kind IS DISTINCT FROM 'LEGEND'),
c AS (SELECT *, status <> 'AI' AS done, coalesce(qty, 0) > 0 AS has, [rate_code, rate_hint, NULL, CASE WHEN category = 'FLOOR_FINISH' THEN 'FF-' || floor_code END, CASE WHEN category = 'SKIRTING' THEN 'SK-' || floor_code END, CASE WHEN category = 'SKIRTING' THEN 'SKIRTING-LM' END,
  CASE WHEN category = 'CEILING' THEN 'CL-' || ceiling_code END] AS slots, category IN (SELECT category FROM asm) AS built FROM s0 WHERE status <> 'AI' OR coalesce(qty, 0) > 0),
k AS (SELECT *, list_filter(list_transform(range(1, 8), lambda i: CASE WHEN i = 3 THEN CASE WHEN built THEN i END WHEN list_contains(codes, slots[i]) THEN i END), lambda i: i IS NOT NULL)[1] AS hit FROM c CROSS JOIN (SELECT list(code) AS codes FROM slot_rate)),
v AS (SELECT k.*, hit IS NOT NULL AND (hit = 3 OR coalesce(r.rate, 0) > 0) AS ok, CASE WHEN hit IS NULL THEN 'RATE_SLOT_MISSING' ELSE 'RATE_MISSING' END AS warn, CASE WHEN hit IS NULL THEN list_filter(slots, lambda x: x IS NOT NULL)[1] ELSE slots[hit] END AS suggested
  FROM k LEFT JOIN slot_rate r ON r.code = slots[hit]),
e AS (SELECT v.*, o.estimability AS ov, v.project_id % 2 = 0 AS served, CASE WHEN factor_confidence < 0.6 AND rate_confidence < 0.6 THEN 'PLACEHOLDER' WHEN category = 'DOOR' THEN 'MEASURED' WHEN category IN ('FLOOR_FINISH', 'WALL_FINISH', 'CEILING', 'SCREED', 'PAINT') THEN 'DERIVED'
    WHEN category = 'JOINERY' THEN 'LUMP_SUM' ELSE 'PROVISIONAL_SUM' END AS base FROM v LEFT JOIN (SELECT project_id AS op, category AS oc, estimability FROM estimability_override) o ON op = v.project_id AND oc = category),
h AS (SELECT *, CASE WHEN ov IN ('MEASURED', 'DERIVED', 'PROVISIONAL', 'PLACEHOLDER', 'MANUAL') THEN ov WHEN served AND base = 'PROVISIONAL_SUM' AND category IN ('MEP_HVAC', 'MEP_ELEC', 'MEP_PLUMB', 'MEP_ELV') THEN 'DERIVED' ELSE base END AS how,
  CASE WHEN category = 'JOINERY' THEN '2.6' WHEN category = 'MEP_HVAC' THEN '2.7' WHEN category = 'MEP_ELEC' THEN '2.71' WHEN category IN ('DOOR', 'WINDOW') THEN '2.8' WHEN category IN ('FLOOR_FINISH', 'WALL_FINISH', 'CEILING', 'SCREED', 'PAINT', 'SKIRTING') THEN '2.9'
    WHEN category IN ('MEP_PROV', 'HOME_AUTOMATION') THEN '4.0' ELSE '1.0' END AS section FROM e),
b AS (SELECT *, CASE how WHEN 'PROVISIONAL_SUM' THEN 2 WHEN 'LUMP_SUM' THEN 3 ELSE CASE WHEN done OR ok THEN 1 ELSE 4 END END AS bucket FROM h WHERE how <> 'PLACEHOLDER'),
u AS (
  SELECT project_id, section, bucket, category, coalesce(tag, chr(65535)) AS o1, item_id AS o2, item_id, CASE WHEN bucket = 4 THEN CASE WHEN warn = 'RATE_SLOT_MISSING' THEN '[RATE SLOT MISSING' || coalesce(' — add ' || suggested, '') ELSE '[RATE MISSING' || coalesce(' — populate ' || suggested, '') END || '] ' || description ELSE description END AS description,
    unit, CAST(coalesce(qty, 0) AS DOUBLE) AS qty, CASE WHEN bucket = 1 AND rule_id IS NOT NULL THEN rule_rate END AS rate, CASE WHEN bucket = 1 AND rule_id IS NOT NULL THEN coalesce(qty, 0) * rule_rate END AS amount, CAST(NULL AS DOUBLE) AS ps_amount, bucket = 1 AND category = 'MEP_PROV' AS is_provisional,
    CASE WHEN bucket = 1 THEN 'mep-rule:' || CASE WHEN rule_rate IS NOT NULL THEN rule_id END END AS rate_source, 1 AS n_items, CASE WHEN bucket = 4 THEN warn END AS warning FROM b WHERE bucket IN (1, 4)
  UNION ALL SELECT project_id, section, bucket, category, '', NULL, NULL, CASE category WHEN 'MEP_HVAC' THEN 'HVAC' WHEN 'MEP_ELEC' THEN 'Electrical' WHEN 'JOINERY' THEN 'Joinery' WHEN 'SKIRTING' THEN 'Skirting' WHEN 'HOME_AUTOMATION' THEN 'Home automation' ELSE replace(category, '_', ' ') END || CASE bucket WHEN 2 THEN ' — provisional sum' ELSE ' — lump sum' END
      || CASE WHEN category = 'MEP_HVAC' THEN ' (P/S 252,000 AED, contractor-typical allowance)' WHEN category = 'MEP_ELEC' THEN ' (P/S 190,000 AED, contractor-typical allowance)' WHEN bucket = 2 THEN ' (P/S, allowance to be confirmed)' ELSE ' (LS, supplier quote pending)' END
      || '; rolled up from ' || count(*) || CASE WHEN count(*) = 1 THEN ' takeoff item' ELSE ' takeoff items' END, 'LS', 1, NULL, NULL, CASE category WHEN 'MEP_HVAC' THEN 252000 WHEN 'MEP_ELEC' THEN 190000 END, TRUE, NULL, count(*), NULL FROM b WHERE bucket IN (2, 3) GROUP BY 1, 2, 3, 4
  UNION ALL SELECT project_id, section, 5, NULL, '', sort_order, NULL, description, unit, qty, rate, amount, ps_amount, is_provisional, NULL, 1, NULL FROM hand_line)
SELECT project_id, section, section || '/' || printf('%03d', row_number() OVER (PARTITION BY project_id, section ORDER BY bucket, CASE WHEN bucket = 5 THEN o2 END, category NULLS FIRST, o1, o2)) AS ref, bucket, category, item_id, description, unit, qty, rate, amount, ps_amount, is_provisional, rate_source, n_items, warning FROM u""",
       ("drawn_item", "org_assembly", "slot_rate", "estimability_override", "hand_line"), dealt=True)
def full_bill(v):
    """A bill from items to numbered lines: classified against the rate library, routed, collapsed, with rates pending and what was typed by hand."""
    assemblies = v("org_assembly").where("takeoff_category IS NOT NULL").select(F.col("takeoff_category").alias("category"))
    served = v("project").where("project_id % 2 = 0").select("project_id")
    return bill.generate(v("drawn_item"), v("slot_rate"), assemblies, v("estimability_override"), served, v("hand_line"))
