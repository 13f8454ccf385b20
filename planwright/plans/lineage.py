"""Queries over provenance payloads: what they are built from, what is read back, and the audit's findings."""

from __future__ import annotations

from pyspark.sql import functions as F

from planwright.functions import evidence
from planwright.functions.numbers import chain_confidence
from planwright.operators import provenance
from planwright.operators.quantify import ALLOWANCES
from planwright.plans.registry import query

# A valid step, by hand: id, type, confidence and weight with their types and ranges; labels and references are text or absent.
_STEP = """(json_type({0}, '$.id') = 'VARCHAR' AND json_extract_string({0}, '$.type') IN ('EXTRACTION', 'MEASUREMENT', 'DERIVATION', 'ASSUMPTION', 'PRIOR') AND json_type({0}, '$.type') = 'VARCHAR'
  AND json_type({0}, '$.confidence') IN ('UBIGINT', 'BIGINT', 'DOUBLE') AND CAST(json_extract_string({0}, '$.confidence') AS DOUBLE) BETWEEN 0 AND 1
  AND json_type({0}, '$.weight') IN ('UBIGINT', 'BIGINT', 'DOUBLE') AND CAST(json_extract_string({0}, '$.weight') AS DOUBLE) BETWEEN 0 AND 1
  AND coalesce(json_type({0}, '$.label') = 'VARCHAR', TRUE) AND coalesce(json_type({0}, '$.sourceRef') = 'VARCHAR', TRUE))"""
_PULL = "pow(greatest(CAST(json_extract_string({0}, '$.confidence') AS DOUBLE), 1e-6), CAST(json_extract_string({0}, '$.weight') AS DOUBLE))"
_ITEM_CHAIN = f"""
, m AS (SELECT *, CASE WHEN json_valid(meta) THEN CAST(meta AS JSON) END AS j FROM item_record),
s AS (SELECT *, CASE WHEN json_type(j, '$.evidenceChain') = 'ARRAY' THEN list_filter(CAST(json_extract(j, '$.evidenceChain') AS JSON[]), lambda x: coalesce({_STEP.format('x')}, FALSE)) ELSE [] END AS steps FROM m),
c AS (SELECT *, CASE WHEN len(steps) > 0 THEN list_reduce(list_transform(steps, lambda x: {_PULL.format('x')}), lambda a, b: a * b)
  WHEN confidence <= 1 THEN confidence ELSE confidence / 100.0::DOUBLE END AS sure FROM s)"""


@query("h60_parsed_chains", _ITEM_CHAIN + """
SELECT item_id, CAST(len(steps) AS INTEGER) AS n_steps, array_to_string(list_transform(steps, lambda x: json_extract_string(x, '$.id')), ',') AS ids, round(CASE WHEN len(steps) > 0 THEN sure ELSE 1 END, 6) AS confidence FROM c""", ("item_record",))
def parsed_chains(v):
    """Steps of the items' chains that have the right form; the others are dropped one by one."""
    steps = F.coalesce(provenance.valid_steps(F.col("meta")), F.array().cast(provenance.STEP_LIST))
    rows = v("item_record").select("item_id", steps.alias("steps"))
    return rows.select("item_id", F.size("steps").alias("n_steps"), F.array_join("steps.id", ",").alias("ids"), F.round(chain_confidence(F.col("steps")), 6).alias("confidence"))


_AT = "coalesce(json_extract(j, '$.position'), json_extract(j, '$.bbox'))"
_BUILT = _ITEM_CHAIN + f""",
r AS (SELECT *, CASE WHEN json_type(j, '$.mepRuleId') = 'VARCHAR' THEN json_extract_string(j, '$.mepRuleId') END AS rule, {_AT} AS place,
  CASE WHEN basis IN ('MEASURED', 'VISUAL') THEN 'm' WHEN basis IN ('DERIVED', 'PARAMETRIC') THEN 'd' WHEN basis IN ('ESTIMATED', 'PLACEHOLDER') THEN 'e' ELSE '?' END AS b FROM c)
SELECT item_id, CASE WHEN rule IS NOT NULL OR b = 'd' THEN 'DERIVED' WHEN b = 'm' THEN 'MEASURED' ELSE 'ESTIMATED' END AS source_type,
  CASE WHEN rule IS NOT NULL THEN 'rule' WHEN b = 'd' THEN 'formula' WHEN b <> 'm' THEN 'ai_reasoning' END AS derivation_type,
  'takeoffItem' || CASE WHEN sheet_id IS NULL THEN '' ELSE ',sheet' END || CASE WHEN rule IS NULL THEN '' ELSE ',mepRule' END AS kinds,
  CASE WHEN rule IS NULL AND b = 'd' THEN CASE WHEN is_provisional THEN 'psAmount carried from takeoff ' || coalesce(tag, description[:30]) ELSE 'amount = qty × rate' END END AS formula, 'mep-rule:' || rule AS rule_ref,
  CASE WHEN rule IS NOT NULL THEN coalesce(json_extract_string(j, '$.mepFormulaText'), 'Derived from MEP rule ' || rule) WHEN b = 'e' THEN coalesce(json_extract_string(j, '$.estimationReasoning'), source_note, 'Estimated from ' || category || ' prior')
    WHEN b = '?' THEN 'Unknown takeoff basis ''' || basis || ''' — defaulted to ESTIMATED' END AS reasoning, round(sure, 6) AS confidence, CAST(len(steps) AS INTEGER) AS n_steps,
  CASE WHEN sheet_id IS NOT NULL THEN coalesce(CASE WHEN json_type(j, '$.extractedValue') = 'VARCHAR' THEN json_extract_string(j, '$.extractedValue') END, nullif(source_note, '')) END AS extracted,
  CASE WHEN sheet_id IS NOT NULL AND json_type(place, '$.x') IN ('UBIGINT', 'BIGINT', 'DOUBLE') AND json_type(place, '$.y') IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN coalesce(json_extract_string(place, '$.cs'), 'dxf-mm') || ' '
    || CAST(CAST(json_extract_string(place, '$.x') AS DOUBLE) AS VARCHAR) || ' ' || CAST(CAST(json_extract_string(place, '$.y') AS DOUBLE) AS VARCHAR) END AS box FROM r"""


@query("i09_line_provenance", _BUILT, ("item_record",))
def line_provenance(v):
    """The payloads of generated lines, read back from their JSON."""
    # The JSON is read in one pass: a second reader would have it built once more.
    built = provenance.build_auto(v("item_record")).withColumn("p", provenance.parse_placed(F.col("provenance")))
    built = built.withColumn("sheet", F.get(F.filter("p.evidence", lambda e: e["kind"] == "sheet"), F.lit(0)))
    at = "sheet.bbox"
    box = F.when(F.col(f"{at}.x").isNotNull(), F.concat_ws(" ", f"{at}.cs", F.col(f"{at}.x").cast("string"), F.col(f"{at}.y").cast("string")))
    return built.select(
        "item_id", F.col("p.sourceType").alias("source_type"), F.col("p.derivationType").alias("derivation_type"), F.array_join("p.evidence.kind", ",").alias("kinds"), "p.formula", F.col("p.ruleRef").alias("rule_ref"), "p.reasoning",
        F.round("p.confidence", 6).alias("confidence"), F.when(F.col("p.evidenceChain").isNull(), 0).otherwise(F.size("p.evidenceChain")).alias("n_steps"), F.col("sheet.extractedValue").alias("extracted"), box.alias("box"))


@query("i09_collapsed_provenance", """
, n AS (SELECT category, item_id, tag, description, row_number() OVER (PARTITION BY category ORDER BY item_id) AS k, count(*) OVER (PARTITION BY category) AS n_items FROM item_record)
SELECT category, n_items, CAST(least(n_items, 25) + (n_items > 25)::INT + 1 AS INTEGER) AS n_evidence, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY k) FILTER (k <= 25) AS ids,
  CASE WHEN n_items > 25 THEN '+' || (n_items - 25) || ' more takeoff items rolled up; ' ELSE '' END || 'Contractor-typical P/S allowance for ' || category || ' — ' || CASE category WHEN 'MEP_HVAC' THEN '252,000 AED from engineer-takeoff defaults' ELSE 'allowance pending estimator confirmation' END
    || '. The app deliberately does not estimate this discipline from the drawing; a contractor / supplier confirms the number.' AS note, 'PROVISIONAL_SUM' AS source_type FROM n GROUP BY category, n_items""", ("item_record",))
def collapsed_provenance(v):
    """The payload of the one line that all items of a category are rolled up into."""
    allowance = F.element_at(F.create_map(*[F.lit(x) for kv in ALLOWANCES.items() for x in kv]), F.col("category")).cast("double")
    rows = provenance.build_collapsed(v("item_record"), ["category"], "PROVISIONAL_SUM", allowance).withColumn("p", provenance.parse(F.col("provenance")))
    listed = F.try_variant_get(F.try_parse_json("provenance"), "$.evidence", "array<struct<kind:string,takeoffItemId:string,note:string>>")
    note = F.array_join(F.transform(F.filter(listed, lambda e: e["kind"] == "legacy"), lambda e: e["note"]), "; ")
    ids = F.array_join(F.transform(F.filter(listed, lambda e: e["kind"] == "takeoffItem"), lambda e: e["takeoffItemId"]), ",")
    return rows.select("category", "n_items", F.size("p.evidence").alias("n_evidence"), ids.alias("ids"), note.alias("note"), F.col("p.sourceType").alias("source_type"))


_T = lambda f, x="e": f"json_type({x}, '$.{f}') = 'VARCHAR'"
_O = lambda f, x="e": f"coalesce(json_type({x}, '$.{f}') = 'VARCHAR', TRUE)"
_N = lambda f, x="e": f"coalesce(json_type({x}, '$.{f}') IN ('VARCHAR', 'NULL'), TRUE)"
_PAGE = "coalesce(json_type(e, '$.pageNo') = 'NULL' OR (json_type(e, '$.pageNo') IN ('UBIGINT', 'BIGINT', 'DOUBLE') AND CAST(json_extract_string(e, '$.pageNo') AS DOUBLE) % 1 = 0), TRUE)"
_BOXED = "(json_type(e, '$.bbox') IS NULL OR (json_extract_string(e, '$.bbox.cs') IN ('dxf-mm', 'pdf-pt', 'pdf-pct') AND json_type(e, '$.bbox.x') IN ('UBIGINT', 'BIGINT', 'DOUBLE') AND json_type(e, '$.bbox.y') IN ('UBIGINT', 'BIGINT', 'DOUBLE')))"
_EVIDENCE = f"""CASE json_extract_string(e, '$.kind') WHEN 'sheet' THEN {_T('sheetId')} AND {_N('drawingNo')} AND {_PAGE} AND {_O('label')} AND {_BOXED} WHEN 'takeoffItem' THEN {_T('takeoffItemId')} AND {_N('tag')} AND {_O('description')} AND {_O('category')}
  WHEN 'document' THEN {_T('documentId')} AND {_T('filename')} AND {_PAGE} AND {_BOXED} WHEN 'rateLibrary' THEN {_T('code')} AND coalesce(json_extract_string(e, '$.scope') IN ('org', 'global'), FALSE) AND {_T('rate')} WHEN 'assembly' THEN {_T('assemblyId')} AND {_O('name')} AND {_N('brandName')}
  WHEN 'user' THEN {_T('userId')} AND {_T('at')} AND {_O('note')} WHEN 'mepRule' THEN {_T('ruleId')} AND {_O('name')} WHEN 'import' THEN {_T('importType')} AND {_T('sourceLabel')} AND {_T('importedAt')} WHEN 'legacy' THEN {_T('note')} ELSE FALSE END"""
_STORED = f"""
, m AS (SELECT *, CASE WHEN json_valid(provenance) THEN CAST(provenance AS JSON) END AS j FROM stored_line),
l AS (SELECT *, CASE WHEN json_type(j, '$.evidence') = 'ARRAY' THEN CAST(json_extract(j, '$.evidence') AS JSON[]) ELSE [] END AS ev, CASE WHEN json_type(j, '$.evidenceChain') = 'ARRAY' THEN CAST(json_extract(j, '$.evidenceChain') AS JSON[]) ELSE [] END AS ch FROM m),
ok0 AS (SELECT *, j IS NOT NULL AND coalesce(json_extract_string(j, '$.sourceType') IN ('MEASURED', 'DERIVED', 'ESTIMATED', 'MANUAL', 'IMPORTED', 'PROVISIONAL_SUM', 'LUMP_SUM'), FALSE)
    AND coalesce(json_extract_string(j, '$.derivationType') IN ('formula', 'rule', 'ai_reasoning'), TRUE) AND {_O('formula', 'j')} AND {_O('ruleRef', 'j')} AND {_O('reasoning', 'j')}
    AND (json_type(j, '$.confidence') IS NULL OR CAST(json_extract_string(j, '$.confidence') AS DOUBLE) BETWEEN 0 AND 1) AND len(ev) > 0 AND len(list_filter(ev, lambda e: NOT coalesce({_EVIDENCE}, FALSE))) = 0
    AND len(list_filter(ch, lambda x: NOT coalesce({_STEP.format('x')}, FALSE))) = 0 AS fits FROM l),
ok AS (SELECT *, CASE WHEN fits THEN json_extract_string(j, '$.sourceType') END AS src, CASE WHEN fits THEN json_extract_string(j, '$.derivationType') END AS der, coalesce(json_extract_string(j, '$.formula'), '') AS formula, coalesce(json_extract_string(j, '$.ruleRef'), '') AS rule,
  coalesce(json_extract_string(j, '$.reasoning'), '') AS why, CAST(json_extract_string(j, '$.confidence') AS DOUBLE) AS own, list_transform(ev, lambda e: json_extract_string(e, '$.kind')) AS kinds, fits AND len(ch) > 0 AS chained,
  CASE WHEN fits AND len(ch) > 0 THEN list_transform(ch, lambda x: {_PULL.format('x')}) END AS pulls FROM ok0),
f AS (SELECT *, coalesce(src IN ('MANUAL', 'IMPORTED', 'PROVISIONAL_SUM', 'LUMP_SUM'), FALSE) AS given,
  CASE WHEN chained THEN list_reduce(pulls, lambda a, b: a * b) WHEN fits AND own IS NOT NULL THEN own WHEN confidence <= 1 THEN confidence ELSE confidence / 100.0::DOUBLE END AS sure FROM ok),
g AS (SELECT *, CASE WHEN chained THEN ch[list_position(pulls, list_min(pulls))] END AS w,
  list_filter([CASE WHEN NOT fits THEN 'no provenance payload — line predates TR-1 or write path missed stamping' END,
    CASE WHEN src = 'DERIVED' AND coalesce(der NOT IN ('formula', 'rule'), TRUE) THEN 'DERIVED requires derivationType=formula|rule (got ' || coalesce(der, 'null') || ')' END,
    CASE WHEN src = 'DERIVED' AND der = 'formula' AND formula = '' THEN 'DERIVED+formula requires provenance.formula' END, CASE WHEN src = 'DERIVED' AND der = 'rule' AND rule = '' THEN 'DERIVED+rule requires provenance.ruleRef' END,
    CASE WHEN src = 'ESTIMATED' AND coalesce(der <> 'ai_reasoning', TRUE) THEN 'ESTIMATED requires derivationType=ai_reasoning (got ' || coalesce(der, 'null') || ')' END, CASE WHEN src = 'ESTIMATED' AND why = '' THEN 'ESTIMATED requires non-empty reasoning' END,
    CASE WHEN src NOT IN ('DERIVED', 'ESTIMATED') AND der IS NOT NULL THEN src || ' should have derivationType=null (got ''' || der || '''); a measured/typed/imported/P-S/LS line has no derivation step' END], lambda x: x IS NOT NULL) AS hard,
  CASE WHEN src = 'MANUAL' AND NOT list_contains(kinds, 'user') AND NOT list_contains(kinds, 'legacy') THEN ['MANUAL line has no user or legacy backfill evidence'] ELSE [] END AS soft0 FROM f),
a0 AS (SELECT *, CASE WHEN len(hard) > 0 THEN [] ELSE soft0 END AS soft, NOT given AND sure < 0.6 AS low, NOT given AND NOT is_provisional AS rated, len(list_filter(kinds, lambda k: k IN ('rateLibrary', 'assembly', 'mepRule', 'import'))) > 0 AS linked FROM g),
a AS (SELECT *, CASE WHEN len(hard) > 0 THEN 'failed' WHEN len(soft) > 0 OR low THEN 'review' ELSE 'verified' END AS quantity_verdict,
  CASE WHEN NOT fits THEN 'failed' WHEN rated AND NOT linked THEN 'review' ELSE 'verified' END AS rate_verdict FROM a0),
t AS (SELECT *, CASE WHEN 'failed' IN (quantity_verdict, rate_verdict) THEN 'failed' WHEN 'review' IN (quantity_verdict, rate_verdict) THEN 'review' ELSE 'verified' END AS status,
  list_concat(list_transform(list_concat(hard, soft), lambda r: 'Integrity: ' || r), list_transform(CASE WHEN NOT low THEN [] WHEN chained THEN
      ['confidence ' || printf('%.2f', floor(sure * 100 + 0.5) / 100) || ' below threshold 0.6 (weighted-compound from evidence chain)', 'weakest step: ' || json_extract_string(w, '$.type') || ' "' || coalesce(json_extract_string(w, '$.label'), json_extract_string(w, '$.id')) || '" c='
        || printf('%.2f', floor(CAST(json_extract_string(w, '$.confidence') AS DOUBLE) * 100 + 0.5) / 100) || ' w=' || printf('%.2f', floor(CAST(json_extract_string(w, '$.weight') AS DOUBLE) * 100 + 0.5) / 100) || ' → contributes ' || printf('%.2f', floor(list_min(pulls) * 100 + 0.5) / 100)]
      ELSE ['confidence ' || printf('%.2f', floor(sure * 100 + 0.5) / 100) || ' below threshold 0.6 (flat — no chain)'] END, lambda r: 'Confidence: ' || r),
    list_transform(CASE WHEN NOT rated OR (fits AND linked) THEN [] WHEN NOT fits THEN ['no provenance — cannot assess rate source'] ELSE ['priced line has no rate source link (assembly / rateLibrary / mepRule / supplier import)'] END, lambda r: 'RateEvidence: ' || r)) AS reasons FROM a)"""


def audited(v):
    return provenance.audit_lines(v("stored_line"))


@query("i10_line_audit", _STORED + " SELECT project_id, item_no, status, quantity_verdict, rate_verdict, array_to_string(reasons, '; ') AS reasons FROM t", ("stored_line",))
def line_audit(v):
    """All findings about stored payloads, with a verdict for the quantity and one for the rate."""
    each = F.flatten(F.transform("modules", lambda m: F.transform(m["findings"], lambda f: F.concat(m["module"], F.lit(": "), f["reason"]))))
    return audited(v).select("project_id", "item_no", "status", "quantity_verdict", "rate_verdict", F.array_join(each, "; ").alias("reasons"))


@query("i10_generated_audit", """
, m AS (SELECT *, CASE WHEN json_valid(meta) THEN CAST(meta AS JSON) END AS j FROM item_record),
s AS (SELECT basis, source_note, coalesce(json_type(j, '$.mepRuleId') = 'VARCHAR', FALSE) AS ruled, coalesce(json_type(j, '$.estimationReasoning') = 'VARCHAR', FALSE) AS reasoned FROM m),
t AS (SELECT CASE WHEN ruled THEN 'DERIVED' WHEN basis IN ('MEASURED', 'VISUAL') THEN 'MEASURED' WHEN basis IN ('DERIVED', 'PARAMETRIC') THEN 'DERIVED' ELSE 'ESTIMATED' END AS source_type,
  coalesce(source_note = '' AND basis IN ('ESTIMATED', 'PLACEHOLDER') AND NOT ruled AND NOT reasoned, FALSE) AS mute FROM s)
SELECT source_type, CASE WHEN mute THEN 'failed' ELSE 'verified' END AS integrity, count(*) AS n FROM t GROUP BY ALL""", ("item_record",))
def generated_audit(v):
    """Lines built from items pass the integrity module, but for estimates whose note is an empty text."""
    lines = provenance.audit_lines(provenance.build_auto(v("item_record")))
    return lines.groupBy(F.col("payload.sourceType").alias("source_type"), F.get("modules", F.lit(0))["verdict"].alias("integrity")).agg(F.count(F.lit(1)).alias("n"))


@query("d13_audit_breakdown", _STORED + """
, d AS (SELECT status, unnest([{'dimension': 'all', 'key': ''}, {'dimension': 'source_type', 'key': coalesce(src, 'UNKNOWN')}, {'dimension': 'derivation_type', 'key': coalesce(der, 'none')}, {'dimension': 'section', 'key': category}]) AS k FROM t)
SELECT k.dimension AS dimension, k.key AS key, count(*) FILTER (status = 'verified') AS verified, count(*) FILTER (status = 'review') AS review, count(*) FILTER (status = 'failed') AS failed FROM d GROUP BY 1, 2""", ("stored_line",))
def audit_breakdown(v):
    return provenance.summary(audited(v), "category")


@query("f06_audit_reasons", _STORED + """
SELECT split_part(r, ': ', 1) AS module, r[length(split_part(r, ': ', 1)) + 3 :] AS reason, count(*) AS n FROM (SELECT unnest(reasons) AS r FROM t) GROUP BY 1, 2 ORDER BY n DESC, module, reason LIMIT 15""", ("stored_line",))
def audit_reasons(v):
    return provenance.top_reasons(audited(v))


# The texts by hand, from the JSON of the kinds that stored lines have.
_TEXT = """CASE json_extract_string(e, '$.kind') WHEN 'sheet' THEN 'sheet s1 p12 @[1,2]' WHEN 'takeoffItem' THEN 'takeoff ' || right(json_extract_string(e, '$.takeoffItemId'), 6) || ' (undefined)' WHEN 'document' THEN 'doc ' || json_extract_string(e, '$.filename') || ' p' || json_extract_string(e, '$.pageNo')
  WHEN 'rateLibrary' THEN 'rate-lib:' || json_extract_string(e, '$.scope') || ':' || json_extract_string(e, '$.code') WHEN 'assembly' THEN 'assembly:' || json_extract_string(e, '$.assemblyId') WHEN 'user' THEN 'user:' || json_extract_string(e, '$.userId') || ' at ' || json_extract_string(e, '$.at')
  WHEN 'mepRule' THEN 'mep-rule:' || json_extract_string(e, '$.ruleId') WHEN 'import' THEN 'import:' || json_extract_string(e, '$.importType') || ' from ' || json_extract_string(e, '$.sourceLabel') WHEN 'legacy' THEN 'legacy: ' || json_extract_string(e, '$.note') END"""


@query("h16_evidence_texts", _STORED + f"""
SELECT project_id, item_no, CASE WHEN len(list_filter(kinds, lambda k: k <> 'takeoffItem')) = 0 THEN array_to_string(list_transform(ev[1:1], lambda e: {_TEXT}), '') ELSE array_to_string(list_transform(list_filter(ev, lambda e: json_extract_string(e, '$.kind') <> 'takeoffItem'), lambda e: {_TEXT}), ' · ') END AS evidence,
  CASE der WHEN 'formula' THEN coalesce(json_extract_string(j, '$.formula'), '(formula not recorded)') WHEN 'rule' THEN why || CASE WHEN rule <> '' THEN chr(10) || '  ' || rule ELSE '' END WHEN 'ai_reasoning' THEN why ELSE '' END AS detail FROM ok WHERE fits""", ("stored_line",))
def evidence_texts(v):
    """Evidence and derivation of stored lines as an export shows them; lines without a valid payload have none."""
    lines = v("stored_line").withColumn("_v", F.try_parse_json("provenance")).withColumn("p", provenance.parse(F.col("provenance")))
    texts = lines.select("project_id", "item_no", F.when(F.col("p").isNotNull(), evidence.summary(F.col("_v"))).alias("evidence"), evidence.detail(F.col("p")).alias("detail"), F.monotonically_increasing_id().alias("_row"))
    return texts.where(F.col("_row") >= 0).where(F.col("evidence").isNotNull()).select("project_id", "item_no", "evidence", "detail")
