"""Domain relations over the driver's tables, as SQL that Spark and DuckDB read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from planwright.session import dealt_by, ranged_by
from planwright.sources.tables import table

#: Relation -> SQL over {tables} and other {relations}. Deterministic, and no relation needs a global sort.
VIEWS = {
    "organization": "SELECT n_nationkey AS org_id, n_name AS org_name, n_regionkey AS region_id FROM {nation}",
    "project": """
        SELECT o_orderkey AS project_id, c_nationkey AS org_id, c_custkey AS client_id, o_orderstatus AS status,
          o_orderdate AS created_at, CAST(o_totalprice / 1000 AS DOUBLE) AS bua_m2
        FROM {orders} JOIN {customer} ON o_custkey = c_custkey""",
    "material": """
        SELECT p_partkey AS material_id, p_name AS name,
          CASE p_partkey % 9 WHEN 0 THEN 'tiles' WHEN 1 THEN 'marble' WHEN 2 THEN 'grout' WHEN 3 THEN 'paint' WHEN 4 THEN 'gypsum'
            WHEN 5 THEN 'cladding' WHEN 6 THEN 'glue' WHEN 7 THEN 'cement' ELSE 'other' END AS category,
          CASE p_size % 4 WHEN 0 THEN 'sqm' WHEN 1 THEN 'bag' WHEN 2 THEN 'piece' ELSE 'liter' END AS unit,
          p_retailprice AS unit_price, CAST(CASE WHEN p_size % 10 = 0 THEN 0 ELSE 1 + p_size % 10 END AS DOUBLE) AS coverage,
          CAST(p_size % 15 AS DOUBLE) AS waste_pct, p_brand AS brand, p_size % 7 <> 0 AS active
        FROM {part}""",
    "supplier_d": "SELECT s_suppkey AS supplier_id, s_name AS name, s_acctbal > 5000 AS preferred, s_nationkey AS org_id FROM {supplier}",
    "price_snapshot": """
        SELECT l_partkey AS material_id, l_suppkey AS supplier_id, FLOOR(l_extendedprice / l_quantity * 100 + 0.5) / 100 AS price,
          CASE WHEN l_linenumber = 7 THEN 'USD' ELSE 'AED' END AS currency, l_shipdate AS effective_date, l_orderkey AS seq, l_linenumber AS seq2
        FROM {lineitem}""",
    "live_price": """
        SELECT material_id, t.supplier_id, price, currency, effective_date, preferred
        FROM (SELECT material_id, supplier_id, MAX_BY(price, (effective_date, seq, seq2, price)) AS price, MAX_BY(currency, (effective_date, seq, seq2, price)) AS currency,
            MAX(effective_date) AS effective_date
          FROM {price_snapshot} GROUP BY material_id, supplier_id) t JOIN {supplier_d} d ON t.supplier_id = d.supplier_id""",
    "space": """
        SELECT l_orderkey AS project_id, l_linenumber AS space_no, MIN(l_quantity) AS length_m, MIN(l_quantity) / 2 + 1 AS width_m,
          CAST(2.4 AS DOUBLE) + MIN(l_tax) * 10 AS height_m, MIN(l_partkey) AS floor_material,
          CASE WHEN MIN(l_linenumber) % 3 = 0 THEN NULL ELSE MAX(l_partkey) END AS wall_material,
          CASE WHEN MIN(l_linenumber) % 4 = 0 THEN NULL ELSE MIN(l_partkey) END AS ceiling_material
        FROM {lineitem} GROUP BY l_orderkey, l_linenumber""",
    "takeoff": """
        SELECT l_orderkey AS project_id,
          CAST(ROW_NUMBER() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_quantity, l_tax, l_discount, l_returnflag, l_linestatus) AS BIGINT) AS item_no,
          CASE l_partkey % 14 WHEN 0 THEN 'ROOM' WHEN 1 THEN 'ROOM' WHEN 2 THEN 'ROOM' WHEN 3 THEN 'DOOR' WHEN 4 THEN 'WINDOW' WHEN 5 THEN 'FLOOR_FINISH'
            WHEN 6 THEN 'WALL_FINISH' WHEN 7 THEN 'CEILING' WHEN 8 THEN 'PAINT' WHEN 9 THEN 'SCREED' WHEN 10 THEN 'SKIRTING' WHEN 11 THEN 'JOINERY'
            WHEN 12 THEN 'MEP_HVAC' ELSE 'OTHER' END AS category,
          CASE WHEN l_partkey % 17 = 0 THEN NULL ELSE CONCAT(CASE l_partkey % 14 WHEN 3 THEN 'D' WHEN 4 THEN 'W' WHEN 5 THEN 'FF' WHEN 6 THEN 'WF' ELSE 'T' END, '-', CAST(l_linenumber AS STRING)) END AS tag,
          CASE l_suppkey % 12 WHEN 0 THEN 'MASTER BEDROOM' WHEN 1 THEN 'BATHROOM' WHEN 2 THEN 'BATH 01' WHEN 3 THEN 'KITCHEN' WHEN 4 THEN 'CORRIDOR' WHEN 5 THEN 'STAIRCASE'
            WHEN 6 THEN 'BALCONY' WHEN 7 THEN 'MAID''S ROOM' WHEN 8 THEN 'STORE SECTION 2' WHEN 9 THEN 'LIVING ROOM — FF-03' WHEN 10 THEN 'GROUND FLOOR — VILLA' ELSE '02 BEDROOM ROOM' END AS description,
          CASE l_partkey % 5 WHEN 0 THEN 'm²' WHEN 1 THEN 'sqm' WHEN 2 THEN 'nr' WHEN 3 THEN 'lm' ELSE 'LS' END AS unit,
          l_quantity AS qty_ai, CASE WHEN l_linestatus = 'F' THEN l_quantity + 1 END AS qty_final,
          CASE l_returnflag WHEN 'A' THEN 'ESTIMATED' WHEN 'N' THEN 'MEASURED' ELSE 'DERIVED' END AS basis,
          CASE WHEN l_tax = 0 THEN 'EDITED' WHEN l_linestatus = 'F' THEN 'APPROVED' ELSE 'AI' END AS status,
          CAST(ROUND(l_discount * 100) AS INT) * 6 + 40 AS confidence,
          CASE l_suppkey % 7 WHEN 0 THEN 'ST01' WHEN 1 THEN 'ST03' WHEN 2 THEN 'PR01' WHEN 3 THEN 'PR03' WHEN 4 THEN 'BATHROOM' WHEN 5 THEN NULL ELSE 'CT09' END AS finish_code,
          CAST(ROUND(l_tax * 100) AS INT) AS door_count, CASE WHEN l_linenumber = 2 THEN NULL ELSE CAST(700 + l_quantity * 10 AS DOUBLE) END AS width_mm,
          CAST(1500 + l_quantity * 50 AS DOUBLE) AS height_mm, l_shipdate AS created_at, l_partkey AS part_id, l_suppkey AS sheet_id, l_extendedprice AS price
        FROM {lineitem}""",
    "boq_line": """
        SELECT project_id, item_no, category, tag, description, unit, CAST(COALESCE(qty_final, qty_ai) AS DECIMAL(14,4)) AS qty,
          CAST(FLOOR(price + 0.5) / 100 AS DECIMAL(14,2)) AS rate, basis = 'ESTIMATED' AS is_provisional,
          CAST(CASE WHEN basis = 'ESTIMATED' THEN price END AS DECIMAL(14,2)) AS ps_amount, confidence, basis, status, finish_code, created_at, part_id
        FROM {takeoff} WHERE category <> 'ROOM'""",
    "rate_library": """
        SELECT org_id, code, unit, CAST(rate AS DECIMAL(14,2)) AS rate FROM (
          SELECT CAST(NULL AS INT) AS org_id, CONCAT('R', CAST(p_partkey % 14 AS STRING)) AS code,
            CASE p_partkey % 14 WHEN 3 THEN 'nr' WHEN 4 THEN 'ea' WHEN 10 THEN 'm' ELSE 'm2' END AS unit, AVG(p_retailprice) AS rate FROM {part} GROUP BY 2, 3
          UNION ALL
          SELECT n_nationkey, CONCAT('R', CAST(n_nationkey % 14 AS STRING)), 'm2', CAST(100 + n_nationkey AS DOUBLE) FROM {nation}) t""",
    "assembly": """
        SELECT assembly_id,
          CASE assembly_id % 14 WHEN 5 THEN 'FLOOR_FINISH' WHEN 8 THEN 'PAINT' WHEN 9 THEN 'SCREED' ELSE NULL END AS takeoff_category,
          CASE assembly_id % 3 WHEN 0 THEN 'WALL' WHEN 1 THEN 'GENERIC' ELSE 'CEILING' END AS applies_to,
          CASE size % 3 WHEN 0 THEN 'm2' WHEN 1 THEN 'nr' ELSE 'm' END AS output_unit,
          CASE size % 4 WHEN 0 THEN NULL WHEN 1 THEN 'ST01' WHEN 2 THEN 'PR01' ELSE 'PR03' END AS finish_code, size AS sort_order
        FROM (SELECT CAST(FLOOR(p_partkey / 10) AS BIGINT) AS assembly_id, MIN(p_size) AS size FROM {part} GROUP BY 1) t""",
    "assembly_component": """
        SELECT CAST(FLOOR(p_partkey / 10) AS BIGINT) AS assembly_id, CASE p_size % 4 WHEN 0 THEN 'MATERIAL' WHEN 1 THEN 'LABOR' WHEN 2 THEN 'MATERIAL' ELSE 'TOOL_FIXED' END AS kind,
          CAST(p_retailprice AS DECIMAL(14,2)) AS unit_price, CASE WHEN p_size % 5 = 0 THEN NULL ELSE CAST(p_size % 40 AS DECIMAL(14,4)) END AS coverage, 1 + p_size % 3 AS coats,
          CAST(p_size % 15 AS DECIMAL(5,2)) AS wastage_pct, CAST(p_size AS DECIMAL(14,2)) AS fixed_cost, p_partkey AS sort_order
        FROM {part}""",
    "mep_rule": """
        SELECT MIN(p_partkey) AS rule_id, driver, factor, unit FROM (
          SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'ROOM_COUNT' WHEN 1 THEN 'BATHROOM_COUNT' WHEN 2 THEN 'KITCHEN_COUNT' WHEN 3 THEN 'BEDROOM_COUNT' WHEN 4 THEN 'AREA_M2' ELSE 'AREA_FT2' END AS driver,
            CAST(p_size % 5 AS DOUBLE) / 2 AS factor, CASE p_size % 3 WHEN 0 THEN 'No' WHEN 1 THEN 'pt' ELSE 'm' END AS unit FROM {part}) t
        GROUP BY driver, factor, unit""",
    "bill_item": """
        SELECT t.project_id, t.item_no, CAST(p.org_id AS BIGINT) AS org_id, t.category,
          CASE WHEN t.part_id % 17 = 0 THEN NULL WHEN t.category = 'FLOOR_FINISH' THEN CONCAT('ff-', COALESCE(t.finish_code, 'X')) WHEN t.category = 'WALL_FINISH' THEN CASE t.sheet_id % 4 WHEN 0 THEN 'WF-PAINT' WHEN 1 THEN 'WF-WD01' WHEN 2 THEN 'WF-ZZ' ELSE 'W-1' END
            WHEN t.category = 'CEILING' THEN CASE t.sheet_id % 3 WHEN 0 THEN 'CL-CL02' WHEN 1 THEN 'CL-CL03' ELSE 'CL-9' END WHEN t.category = 'JOINERY' THEN CASE t.sheet_id % 4 WHEN 0 THEN 'VAN-1' WHEN 1 THEN 'KB-2' WHEN 2 THEN 'kw-3' ELSE 'J-1' END
            WHEN t.category = 'OTHER' THEN CASE t.sheet_id % 3 WHEN 0 THEN 'STAIR-TREAD' WHEN 1 THEN 'thresh' ELSE 'O-1' END ELSE t.tag END AS tag,
          CASE WHEN t.category = 'DOOR' THEN CASE t.sheet_id % 3 WHEN 0 THEN 'door 1000 x 3000' WHEN 1 THEN 'door 900 x 2400' ELSE 'door' END ELSE t.description END AS description,
          CASE t.category WHEN 'DOOR' THEN 'No' WHEN 'WINDOW' THEN 'nr' WHEN 'SKIRTING' THEN 'lm' WHEN 'JOINERY' THEN 'lm' WHEN 'OTHER' THEN 'lm' ELSE t.unit END AS unit,
          t.finish_code, COALESCE(t.qty_final, t.qty_ai) AS qty, CASE WHEN t.part_id % 19 = 0 THEN NULL ELSE t.project_id * 100 + t.item_no END AS item_id,
          CAST(CASE WHEN t.category = 'MEP_HVAC' AND t.sheet_id % 2 = 0 THEN 12.5 END AS DOUBLE) AS rate, CASE WHEN t.category = 'MEP_HVAC' AND t.sheet_id % 2 = 0 THEN 'mep-rule:7' END AS source,
          t.basis = 'ESTIMATED' AS is_provisional, CASE WHEN t.basis = 'ESTIMATED' THEN t.price END AS ps_amount
        FROM {takeoff} t JOIN {project} p ON t.project_id = p.project_id WHERE t.category <> 'ROOM'""",
    "org_assembly": """
        SELECT a.assembly_id, CAST(a.assembly_id % 25 AS BIGINT) AS org_id, a.takeoff_category, CASE WHEN a.assembly_id % 4 = 3 THEN 'FLOOR' ELSE a.applies_to END AS applies_to, a.output_unit,
          CASE a.sort_order % 4 WHEN 0 THEN NULL WHEN 1 THEN 'ST01' WHEN 2 THEN 'PR01,PR03' ELSE 'BATHROOM,ST03,CT09' END AS finish_list, a.sort_order
        FROM {assembly} a""",
    "code_rate": """
        SELECT org_id, code, unit, CAST(ROUND(AVG(price), 2) AS DOUBLE) AS rate FROM (
          SELECT CASE WHEN p_size % 3 = 0 THEN CAST(p_size % 25 AS BIGINT) END AS org_id, p_retailprice AS price,
            CASE p_partkey % 16 WHEN 0 THEN 'FLR-ST01' WHEN 1 THEN 'FLR-PR01' WHEN 2 THEN 'FLR-BATH' WHEN 3 THEN 'PAINT-INT' WHEN 4 THEN 'WALL-WOODPORC' WHEN 5 THEN 'CEIL-CL02' WHEN 6 THEN 'CEIL-CL03' WHEN 7 THEN 'STAIR-TREAD' WHEN 8 THEN 'THRESH'
              WHEN 9 THEN 'VANITY' WHEN 10 THEN 'KIT-BASE' WHEN 11 THEN 'KIT-WALL' WHEN 12 THEN 'SCREED-FLR' WHEN 13 THEN 'SKIRT-PR01' WHEN 14 THEN 'DOOR-1000x3000-FN01' ELSE 'DOOR-STD-LACQ' END AS code,
            CASE WHEN p_partkey % 16 IN (14, 15) THEN 'nr' WHEN p_partkey % 16 IN (7, 8, 10, 11, 13) THEN 'm' ELSE 'm2' END AS unit FROM {part}) t GROUP BY org_id, code, unit""",
    "slot_rate": """
        SELECT code, CAST(CASE WHEN MIN(p_partkey) % 3 = 0 THEN 0 ELSE ROUND(AVG(p_retailprice), 2) END AS DOUBLE) AS rate FROM (
          SELECT p_partkey, p_retailprice, CASE p_partkey % 7 WHEN 0 THEN 'FF-ST01' WHEN 1 THEN 'FF-PR01' WHEN 2 THEN 'SKIRTING-LM' WHEN 3 THEN 'CL-CL02' WHEN 4 THEN 'SK-ST01' WHEN 5 THEN 'DOOR-1' ELSE 'FF-ST03' END AS code FROM {part}) t GROUP BY code""",
    "drawn_item": """
        SELECT project_id, project_id * 100 + item_no AS item_id, CASE WHEN category = 'SKIRTING' AND sheet_id % 5 = 0 THEN 'MEP_PROV' WHEN category = 'OTHER' AND sheet_id % 3 = 0 THEN 'MEP_ELEC' WHEN category = 'OTHER' AND sheet_id % 3 = 1 THEN 'HOME_AUTOMATION' ELSE category END AS category,
          tag, description, unit, CASE WHEN sheet_id % 11 = 0 THEN NULL WHEN sheet_id % 13 = 0 THEN 0 ELSE COALESCE(qty_final, qty_ai) END AS qty, status, CASE WHEN part_id % 37 = 0 THEN 'LEGEND' END AS kind,
          CASE WHEN category = 'DOOR' AND sheet_id % 2 = 0 THEN 'DOOR-1' END AS rate_code, CASE WHEN category = 'WALL_FINISH' THEN 'WALL-NEW' END AS rate_hint, finish_code AS floor_code, CASE sheet_id % 3 WHEN 0 THEN 'CL02' WHEN 1 THEN 'CL03' END AS ceiling_code,
          CASE WHEN category = 'MEP_HVAC' AND sheet_id % 2 = 0 THEN CONCAT('r', CAST(part_id % 5 AS STRING)) END AS rule_id, CAST(CASE WHEN category = 'MEP_HVAC' THEN 40 + part_id % 9 END AS DOUBLE) AS rule_rate,
          CAST(CASE WHEN category = 'MEP_HVAC' THEN confidence / 100.0 END AS DOUBLE) AS factor_confidence, CAST(CASE WHEN category = 'MEP_HVAC' AND part_id % 3 = 0 THEN 0.5 ELSE 0.9 END AS DOUBLE) AS rate_confidence
        FROM {takeoff}""",
    "estimability_override": """
        SELECT project_id, CASE WHEN project_id % 7 = 0 THEN 'MEP_HVAC' WHEN project_id % 5 = 0 THEN 'JOINERY' WHEN project_id % 11 = 0 THEN 'DOOR' ELSE 'PAINT' END AS category,
          CASE WHEN project_id % 7 = 0 THEN 'PROVISIONAL' WHEN project_id % 5 = 0 THEN 'MEASURED' WHEN project_id % 11 = 0 THEN 'LUMP_SUM' ELSE 'PLACEHOLDER' END AS estimability FROM {project} WHERE project_id % 7 = 0 OR project_id % 5 = 0 OR project_id % 11 = 0 OR project_id % 13 = 0""",
    "hand_line": """
        SELECT project_id, CASE WHEN k = 1 THEN '2.9' ELSE '4.0' END AS section, k AS sort_order, CASE k WHEN 0 THEN 'Windows' WHEN 1 THEN 'Lighting' ELSE 'Facade' END AS description, 'LS' AS unit, CAST(1 AS DOUBLE) AS qty,
          CAST(CASE WHEN k = 1 THEN 70 END AS DOUBLE) AS rate, CAST(CASE WHEN k = 1 THEN 70 END AS DOUBLE) AS amount, CAST(CASE WHEN k <> 1 THEN 100000 * (k + 1) END AS DOUBLE) AS ps_amount, k <> 1 AS is_provisional
        FROM (SELECT project_id, CAST(project_id % 3 AS INT) AS k FROM {project} UNION ALL SELECT project_id, 2 AS k FROM {project} WHERE project_id % 4 = 0 AND project_id % 3 <> 2) t""",
    "legend_line": """
        SELECT project_id, item_no, CONCAT(CASE part_id % 7 WHEN 0 THEN 'GROUND FLOOR' WHEN 1 THEN '' WHEN 2 THEN 'Lobby, see A301      WHITE MARBLE' ELSE description END, CHR(10), CASE WHEN item_no % 3 = 0 THEN CHR(10) ELSE '' END, '            ',
          CASE finish_code WHEN 'BATHROOM' THEN 'Bathroom  finishes (As per drawings)' WHEN 'PR01' THEN 'I401      PR01 tile' ELSE COALESCE(finish_code, 'WD01-FN03') END,
          CASE part_id % 5 WHEN 0 THEN '          19.04 m²' WHEN 1 THEN '        Drawing 3' WHEN 2 THEN '       ST01' ELSE '' END, '                    ', CASE part_id % 3 WHEN 0 THEN 'Interior Floor Finish' WHEN 1 THEN '' ELSE 'Service   Areas' END,
          CHR(10), CASE sheet_id % 4 WHEN 0 THEN 'Honed 600 x 600' WHEN 1 THEN '' WHEN 2 THEN 'plain' ELSE CONCAT('gloss white', CHR(10), CHR(10), CHR(10), CHR(10), CHR(10)) END) AS lines
        FROM {takeoff}""",
    "price_entry": """
        SELECT CAST(d.org_id AS BIGINT) AS org_id, e.material_id, e.supplier_id, e.price, e.currency, CAST(e.effective_date AS TIMESTAMP) AS effective_date, CASE e.entry % 5 WHEN 0 THEN TRUE WHEN 1 THEN FALSE ELSE NULL END AS preferred, e.entry, e.seq % 2 AS batch
        FROM (SELECT seq * 10 + seq2 AS entry, seq, MIN(material_id) AS material_id, MIN(supplier_id) AS supplier_id, MIN(price) AS price, MIN(currency) AS currency, MIN(effective_date) AS effective_date
          FROM {price_snapshot} GROUP BY seq, seq2) e JOIN {supplier_d} d ON e.supplier_id = d.supplier_id""",
    # Braces of JSON are written as < and > here.
    "item_record": """
        SELECT project_id * 100 + item_no AS item_id, project_id, item_no, category, tag, description, CASE WHEN part_id % 23 = 0 THEN 'VISUAL' WHEN part_id % 29 = 0 THEN 'GUESS' WHEN part_id % 31 = 0 THEN 'PLACEHOLDER' ELSE basis END AS basis, confidence,
          basis = 'ESTIMATED' AS is_provisional, CASE part_id % 4 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE CONCAT('note ', CAST(item_no AS STRING)) END AS source_note,
          CASE WHEN sheet_id % 6 = 0 THEN NULL ELSE sheet_id END AS sheet_id, CASE WHEN sheet_id % 5 = 0 THEN NULL ELSE CONCAT('A', CAST(sheet_id % 100 AS STRING)) END AS drawing_no, sheet_id % 40 AS page_no,
          CASE WHEN sheet_id % 3 = 0 THEN '' ELSE 'DOOR SCHEDULE' END AS title, CASE WHEN sheet_id % 4 = 0 THEN NULL ELSE 'schedule' END AS sheet_type, CONCAT('set', CAST(sheet_id % 7 AS STRING), '.pdf') AS filename,
          TRANSLATE(CASE part_id % 11
            WHEN 0 THEN NULL WHEN 1 THEN 'no json' WHEN 2 THEN '<"evidenceChain":"none","position":<"x":1,"y":2.5>>' WHEN 3 THEN '<"mepRuleId":"hvac","mepDiscipline":"HVAC","mepFormulaText":"rooms x 2","mepFactorSource":"sheet">'
            WHEN 4 THEN '<"mepRuleId":"sockets">' WHEN 5 THEN '<"estimationReasoning":"4-bed villa","extractedValue":"GF-04","bbox":<"x":"left","y":0>>'
            ELSE CONCAT('<"evidenceChain":[<"id":"s1","type":"EXTRACTION","confidence":', CAST(confidence AS STRING), 'e-2,"weight":0.6,"label":"read">,<"id":"s2","type":"GUESS","confidence":0.9,"weight":0.5>,<"id":"s3","type":"PRIOR","confidence":0.7',
              ',"weight":', CASE WHEN item_no % 2 = 0 THEN '1.5' ELSE '0.5' END, '>,<"id":4,"type":"PRIOR","confidence":1,"weight":1>],"bbox":<"cs":"pdf-pt","x":3,"y":4,"w":5>>') END, '<>', CONCAT(CHR(123), CHR(125))) AS meta
        FROM {takeoff}""",
    "stored_line": """
        SELECT project_id, item_no, category, is_provisional, confidence,
          TRANSLATE(CASE part_id % 15
            WHEN 0 THEN NULL WHEN 1 THEN '<"sourceType":"DERIVED"'
            WHEN 2 THEN CONCAT('<"sourceType":"MEASURED","derivationType":null,"evidence":[<"kind":"sheet","sheetId":"s1","drawingNo":null,"pageNo":', CASE WHEN item_no = 5 THEN '3.5' ELSE '12' END, ',"bbox":<"cs":"dxf-mm","x":1,"y":2>>],"evidenceChain":[<"id":"a","type":"EXTRACTION","confidence":0.', CAST(confidence % 100 AS STRING), ',"weight":0.6>]>')
            WHEN 3 THEN CONCAT('<"sourceType":"DERIVED","derivationType":"formula","formula":"amount = qty x rate","evidence":[<"kind":"takeoffItem","takeoffItemId":"t1","tag":null>,<"kind":"rateLibrary","code":"R1","scope":"', CASE WHEN item_no = 3 THEN 'local' ELSE 'org' END, '","rate":"12.50">],"confidence":0.', CAST(confidence % 100 AS STRING), '>')
            WHEN 4 THEN '<"sourceType":"DERIVED","derivationType":"formula","evidence":[<"kind":"takeoffItem","takeoffItemId":"t1">]>'
            WHEN 5 THEN CONCAT('<"sourceType":"DERIVED","derivationType":"rule"', CASE WHEN item_no % 2 = 0 THEN ',"ruleRef":"mep-rule:hvac"' ELSE '' END, ',"evidence":[<"kind":"mepRule","ruleId":"hvac">],"evidenceChain":[]>')
            WHEN 6 THEN CONCAT('<"sourceType":"ESTIMATED","derivationType":"ai_reasoning","reasoning":"', CASE WHEN item_no = 4 THEN '' ELSE 'villa norm' END, '","evidence":[<"kind":"assembly","assemblyId":"a1","brandName":null>],"evidenceChain":[<"id":"p","type":"PRIOR","confidence":0.75,"weight":0.5>,<"id":"q","type":"ASSUMPTION","confidence":0.', CAST(confidence % 100 AS STRING), ',"weight":0.8,"label":"height","sourceRef":"A1">]>')
            WHEN 7 THEN '<"sourceType":"ESTIMATED","derivationType":"formula","evidence":[<"kind":"legacy","note":"old">]>'
            WHEN 8 THEN '<"sourceType":"MANUAL","evidence":[<"kind":"takeoffItem","takeoffItemId":"t9","extra":1>]>'
            WHEN 9 THEN '<"sourceType":"MANUAL","derivationType":"rule","evidence":[<"kind":"user","userId":"u","at":"2024-01-01">]>'
            WHEN 10 THEN '<"sourceType":"IMPORTED","evidence":[<"kind":"import","importType":"supplier-quote","sourceLabel":"q.pdf","importedAt":"2024-01-01">]>'
            WHEN 11 THEN CONCAT('<"sourceType":"MEASURED","evidence":[<"kind":"document","documentId":"d","filename":"f.pdf","pageNo":"', CAST(item_no AS STRING), '">]>')
            WHEN 12 THEN '<"sourceType":"PROVISIONAL_SUM","evidence":[<"kind":"legacy","note":"rolled up">],"confidence":1>'
            WHEN 13 THEN '<"sourceType":"MEASURED","evidence":[]>'
            ELSE '<"sourceType":"DERIVED","evidence":[<"kind":"document","documentId":"d","filename":"f.pdf","pageNo":2>],"inputs":[<"name":"area","value":3,"source":<"kind":"legacy","note":"n">>]>' END, '<>', CONCAT(CHR(123), CHR(125))) AS provenance
        FROM {boq_line}""",
    "job": """
        SELECT event_id AS job_id, user_id AS org_id, ts AS created_at, event_type,
          CASE event_type WHEN 'signup' THEN 'QUEUED' WHEN 'click' THEN 'RUNNING' WHEN 'view' THEN 'DONE' WHEN 'error' THEN 'FAILED' ELSE 'QUEUED' END AS status,
          CASE WHEN event_type IN ('click', 'view', 'error') THEN ts END AS started_at, CASE WHEN event_type = 'purchase' AND value > 50 THEN ts + INTERVAL '1' DAY END AS scheduled_for,
          CAST(event_id % 4 AS INT) AS attempts, props FROM {events}""",
    "point": """
        SELECT vec_id AS point_id, CASE WHEN vec_id % 3 = 0 THEN 'AREA' ELSE 'NAME' END AS kind, label AS page,
          CAST({e0} AS DOUBLE) * 1000 AS x, CAST({e1} AS DOUBLE) * 1000 AS y FROM {embeddings}""",
}
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]
_SPARK = {"e0": "embedding[0]", "e1": "embedding[1]"}
_DUCK = {"e0": "embedding[1]", "e1": "embedding[2]"}


def _names(sql: str) -> list[str]:
    return [n for n in [*TABLES, *VIEWS] if "{" + n + "}" in sql]


def view(spark: SparkSession, sf_dir: str, name: str, dealt: bool | str = False) -> DataFrame:
    """A driver table or a domain relation.

    `dealt` is for relations that number or group the lines of an order: these are made from lines that were dealt by order
    into tasks of a stated size, so they travel once, as the plain columns of the table, and a task holds no more of a larger table.
    "ranges" deals them in ranges of orders.
    """
    if name in TABLES:
        return table(spark, sf_dir, name)
    sql = VIEWS[name]
    needed = {n: view(spark, sf_dir, n, dealt) for n in _names(sql)}
    if dealt and "lineitem" in needed:
        deal = ranged_by if dealt == "ranges" else dealt_by
        needed["lineitem"] = deal(needed["lineitem"], needed["lineitem"].count(), "l_orderkey")
    return spark.sql(sql.replace("{e0}", _SPARK["e0"]).replace("{e1}", _SPARK["e1"]), **needed)


def duck(*names: str) -> str:
    """`WITH` clause for DuckDB with the relations given and those they need."""
    done: dict[str, str] = {}

    def add(name: str) -> None:
        if name in TABLES or name in done:
            return
        sql = VIEWS[name]
        for n in _names(sql):
            add(n)
        for n in _names(sql):
            sql = sql.replace("{" + n + "}", n)
        done[name] = sql.replace("{e0}", _DUCK["e0"]).replace("{e1}", _DUCK["e1"])

    for name in names:
        add(name)
    return "WITH " + ",\n".join(f"{n} AS ({sql})" for n, sql in done.items()) + "\n"
