"""Provenance payloads: forms, what is dropped, what is built per basis, and every finding of the audit."""

import json

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from planwright import plans
from planwright.operators import provenance as P

SHEET = {"kind": "sheet", "sheetId": "s", "drawingNo": None, "pageNo": 3, "bbox": {"cs": "pdf-pt", "x": 1, "y": 2.5}}
GOOD = {"sourceType": "MEASURED", "derivationType": None, "evidence": [SHEET], "confidence": 1, "unknown": {"field": 1}}


def parsed(spark, texts):
    return [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(P.parse(F.col("t")).alias("p")).collect()]


def with_(**changes):
    return json.dumps({k: v for k, v in (GOOD | changes).items() if v != "absent"})


def evidence(**changes):
    return with_(evidence=[{k: v for k, v in (SHEET | changes).items() if v != "absent"}])


def test_what_fits_is_read(spark):
    steps = [{"id": "a", "type": "PRIOR", "confidence": 0, "weight": 1, "label": "l"}]
    inputs = [{"name": "area", "value": "3"}, {"name": "n", "value": 4, "unit": "m", "source": {"kind": "legacy", "note": "x"}}]
    others = [{"kind": "takeoffItem", "takeoffItemId": "t", "tag": None}, {"kind": "document", "documentId": "d", "filename": "f", "pageNo": 2.0}, {"kind": "rateLibrary", "code": "c", "scope": "global", "rate": "1"}, {"kind": "assembly", "assemblyId": "a"},
              {"kind": "user", "userId": "u", "at": "now"}, {"kind": "mepRule", "ruleId": "r"}, {"kind": "import", "importType": "t", "sourceLabel": "s", "importedAt": "n"}, {"kind": "legacy", "note": ""}]
    got = parsed(spark, [with_(), with_(evidenceChain=steps, inputs=inputs), with_(evidence=others), with_(evidenceChain=[]), evidence(pageNo=None, bbox="absent")])
    assert all(p is not None for p in got)
    assert got[0].sourceType == "MEASURED" and got[0].derivationType is None and got[0].confidence == 1.0 and got[0].evidenceChain is None
    assert [e.kind for e in got[2].evidence] == [o["kind"] for o in others]
    assert got[1].evidenceChain[0].asDict() == {"id": "a", "type": "PRIOR", "confidence": 0.0, "weight": 1.0, "label": "l", "sourceRef": None}


def test_what_does_not_fit_is_null_as_a_whole(spark):
    bad = [
        None, "", "null", "no json", "[]", "3", "{}", with_(sourceType="absent"), with_(sourceType="GUESS"), with_(sourceType=None), with_(derivationType="magic"), with_(derivationType=3), with_(evidence=[]), with_(evidence=None), with_(evidence="absent"),
        with_(evidence={}), with_(evidence=[None]), with_(evidence=[{}]), with_(evidence=[SHEET, {"kind": "unknown"}]), with_(formula=None), with_(formula=1), with_(reasoning=None), with_(confidence=1.01), with_(confidence=-1), with_(confidence="1"), with_(confidence=None),
        with_(inputs=[{"name": "x", "value": None}]), with_(inputs=[{"name": "x", "value": 1, "source": {"kind": "legacy"}}]), with_(evidenceChain=[{"id": "a", "type": "PRIOR", "confidence": 2, "weight": 1}]), with_(evidenceChain=None),
        evidence(sheetId=1), evidence(sheetId="absent"), evidence(pageNo="3"), evidence(pageNo=3.5), evidence(label=None), evidence(bbox=None), evidence(bbox={"cs": "px", "x": 1, "y": 1}), evidence(bbox={"cs": "pdf-pt", "x": "1", "y": 1}), evidence(bbox={"cs": "pdf-pt", "x": 1})]
    assert [b for b, p in zip(bad, parsed(spark, bad), strict=True) if p is not None] == []


def test_steps_are_dropped_one_by_one(spark):
    step = {"id": "a", "type": "PRIOR", "confidence": 0.5, "weight": 0.5}
    chains = [[step, {"id": "b"}, step | {"id": 7}, step | {"type": "HUNCH"}, step | {"weight": 1.5}, step | {"label": None}, step | {"id": "z", "weight": 1}], [{"id": "b"}], [], "text", None]
    texts = [json.dumps({"evidenceChain": c}) for c in chains] + [None, "no json", "{}"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(P.valid_steps(F.col("t"))).collect()]
    assert [s.id for s in got[0]] == ["a", "z"] and got[1:] == [None] * 7


ITEM = "item_id bigint, tag string, description string, category string, basis string, confidence int, meta string, source_note string, sheet_id bigint, drawing_no string, page_no int, title string, sheet_type string, filename string, is_provisional boolean"


def item(k, basis="MEASURED", meta=None, tag="T1", note=None, sheet=5, provisional=False, confidence=80, description="Hall " * 40):
    return (k, tag, description, "PAINT", basis, confidence, meta and json.dumps(meta), note, sheet, "A1", 3, "PLAN", "", "f.pdf", provisional)


def built(spark, rows):
    out = P.build_auto(spark.createDataFrame(rows, ITEM)).withColumn("p", P.parse(F.col("provenance"))).collect()
    assert all(r.p is not None for r in out)
    return {r.item_id: json.loads(r.provenance) for r in out}


def test_payloads_by_basis(spark):
    chain = {"evidenceChain": [{"id": "a", "type": "EXTRACTION", "confidence": 0.25, "weight": 0.5}, {"id": "bad"}]}
    got = built(spark, [
        item(1), item(2, "VISUAL", chain), item(3, "DERIVED"), item(4, "PARAMETRIC", provisional=True, tag=None), item(5, "ESTIMATED"), item(6, "PLACEHOLDER", {"estimationReasoning": "norm"}), item(7, "ESTIMATED", note="seen"), item(8, "ODD"), item(9, None),
        item(10, "MEASURED", {"mepRuleId": "r1", "mepDiscipline": "HVAC", "mepFormulaText": "2 x 3"}), item(11, "ESTIMATED", {"mepRuleId": "r2", "mepFactorSource": "f"}), item(12, sheet=None), item(13, meta={"position": {"x": 1, "y": 2, "w": "wide"}, "extractedValue": "GF-04"}),
        item(14, meta={"position": {"x": "a", "y": 2}}, note="n"), item(15, confidence=None, tag=None)])
    assert (got[1]["sourceType"], got[1].get("derivationType"), got[1]["confidence"], "evidenceChain" in got[1]) == ("MEASURED", None, 0.8, False)
    assert got[2]["confidence"] == 0.5 and [s["id"] for s in got[2]["evidenceChain"]] == ["a"]
    assert got[3]["formula"] == "amount = qty × rate" and got[4]["formula"] == "psAmount carried from takeoff " + ("Hall " * 40)[:30]
    assert [got[k]["reasoning"] for k in (5, 6, 7, 8, 9)] == ["Estimated from PAINT prior", "norm", "seen", "Unknown takeoff basis 'ODD' — defaulted to ESTIMATED", "Unknown takeoff basis 'null' — defaulted to ESTIMATED"]
    assert all(got[k]["sourceType"] == "ESTIMATED" and got[k]["derivationType"] == "ai_reasoning" for k in (5, 6, 7, 8, 9))
    assert (got[10]["sourceType"], got[10]["derivationType"], got[10]["ruleRef"], got[10]["reasoning"], got[10]["stampedBy"]) == ("DERIVED", "rule", "mep-rule:r1", "2 x 3", "generateBoq.auto.mep")
    assert got[10]["evidence"][-1] == {"kind": "mepRule", "ruleId": "r1", "name": "HVAC / " + "Hall " * 40} and got[11]["reasoning"] == "Derived from MEP rule r2"
    assert [e["kind"] for e in got[12]["evidence"]] == ["takeoffItem"] and len(got[12]["evidence"][0]["description"]) == 100
    sheet = got[13]["evidence"][1]
    assert sheet["bbox"] == {"cs": "dxf-mm", "x": 1.0, "y": 2.0} and sheet["extractedValue"] == "GF-04" and sheet["sheetTitle"] == "PLAN" and "sheetType" not in sheet
    assert "bbox" not in got[14]["evidence"][1] and got[14]["evidence"][1]["extractedValue"] == "n" and got[15]["confidence"] == 0.0


def test_collapsed_lines_name_25_items(spark):
    rows = [item(k, tag=None if k % 2 else f"T{k}") for k in range(40)]
    data = spark.createDataFrame(rows, ITEM).withColumn("project", F.lit(None).cast("int"))
    (line,) = P.build_collapsed(data, ["project", "category"], "LUMP_SUM", F.lit(252000.0)).collect()
    payload = json.loads(line.provenance)
    named = [e["takeoffItemId"] for e in payload["evidence"] if e["kind"] == "takeoffItem"]
    assert line.n_items == 40 and named == [str(k) for k in range(25)] and payload["evidence"][25]["note"] == "+15 more takeoff items rolled up"
    assert payload["evidence"][26]["note"].startswith("Contractor-typical LS supplier-quote allowance for PAINT — 252,000 AED from engineer-takeoff defaults.") and payload["stampedBy"] == "generateBoq.lumpSumCollapse"
    few = json.loads(P.build_collapsed(data.where("item_id < 3"), ["project", "category"], "PROVISIONAL_SUM").head().provenance)
    assert len(few["evidence"]) == 4 and "allowance pending estimator confirmation" in few["evidence"][3]["note"]
    assert P.build_collapsed(data.limit(0), ["category"], "LUMP_SUM").collect() == []
    with pytest.raises(ValueError):
        P.build_collapsed(data, ["category"], "MEASURED")


def audited(spark, payloads, confidence=80, provisional=False):
    rows = [(k, p if p is None or isinstance(p, str) else json.dumps(p), confidence, provisional) for k, p in enumerate(payloads)]
    out = P.audit_lines(spark.createDataFrame(rows, "k int, provenance string, confidence int, is_provisional boolean")).orderBy("k").collect()
    return [(r.status, r.quantity_verdict, r.rate_verdict, [(m.module, f.reason, f.tag) for m in r.modules for f in m.findings]) for r in out]


def test_findings(spark):
    rate = {"kind": "assembly", "assemblyId": "a"}
    user = {"kind": "user", "userId": "u", "at": "n"}
    weak = [{"id": "a", "type": "EXTRACTION", "confidence": 0.9, "weight": 0.6}, {"id": "b", "type": "ASSUMPTION", "confidence": 0.4, "weight": 0.8, "label": "height", "sourceRef": "A1"}]
    base = {"evidence": [rate], "confidence": 0.9}
    got = audited(spark, [
        None, base | {"sourceType": "MEASURED"}, {"sourceType": "MEASURED", "evidence": [SHEET], "confidence": 0.9}, base | {"sourceType": "MEASURED", "derivationType": "rule"}, base | {"sourceType": "DERIVED"}, base | {"sourceType": "DERIVED", "derivationType": "formula", "formula": ""},
        base | {"sourceType": "DERIVED", "derivationType": "rule"}, base | {"sourceType": "ESTIMATED", "derivationType": "formula"}, base | {"sourceType": "MANUAL"}, {"sourceType": "MANUAL", "evidence": [user], "confidence": 0.1}, base | {"sourceType": "LUMP_SUM", "derivationType": "formula"},
        base | {"sourceType": "MEASURED", "evidenceChain": weak}, base | {"sourceType": "MEASURED", "confidence": 0.594}, base | {"sourceType": "MEASURED", "evidenceChain": []}])
    verdicts = [g[:3] for g in got]
    assert verdicts[0] == ("failed", "failed", "failed") and [f[2] for f in got[0][3]] == ["MISSING_PROVENANCE", "MISSING_PROVENANCE"]
    assert got[1] == ("verified", "verified", "verified", [])
    # No source for the rate never lowers the verdict on the quantity.
    assert verdicts[2] == ("review", "verified", "review") and got[2][3][0][2] == "NO_RATE_EVIDENCE"
    assert got[3][3][0][1] == "MEASURED should have derivationType=null (got 'rule'); a measured/typed/imported/P-S/LS line has no derivation step"
    assert [g[3][0][1] for g in got[4:7]] == ["DERIVED requires derivationType=formula|rule (got null)", "DERIVED+formula requires provenance.formula", "DERIVED+rule requires provenance.ruleRef"]
    assert [f[2] for f in got[7][3]] == ["BAD_DERIVATION", "MISSING_REASONING"] and all(v == ("failed", "failed", "verified") for v in verdicts[3:8])
    assert verdicts[8] == ("review", "review", "verified") and got[8][3] == [("Integrity", "MANUAL line has no user or legacy backfill evidence", "MISSING_EVIDENCE")]
    assert got[9] == ("verified", "verified", "verified", []) and verdicts[10][0] == "failed"
    total = 0.9**0.6 * 0.4**0.8
    assert got[11][3] == [("Confidence", f"confidence {total:.2f} below threshold 0.6 (weighted-compound from evidence chain)", "LOW_CONF"), ("Confidence", f'weakest step: ASSUMPTION "height" c=0.40 w=0.80 → contributes {0.4**0.8:.2f}', "LOW_CONF")]
    assert got[12][3] == [("Confidence", "confidence 0.59 below threshold 0.6 (flat — no chain)", "LOW_CONF")] and got[13][3] == []
    flat = audited(spark, [{"sourceType": "MEASURED", "evidence": [rate]}], confidence=50)
    assert flat[0][:3] == ("review", "review", "verified") and audited(spark, [{"sourceType": "MEASURED", "evidence": [rate]}], confidence=None)[0][1] == "review"
    assert audited(spark, [{"sourceType": "MEASURED", "evidence": [SHEET], "confidence": 1}], provisional=True)[0] == ("verified", "verified", "verified", [])


def test_summary_and_reasons(spark):
    rows = [(json.dumps({"sourceType": "MANUAL", "evidence": [SHEET]}), 90, False, "A"), (None, 90, False, "A"), (None, 90, False, None)]
    lines = P.audit_lines(spark.createDataFrame(rows, "provenance string, confidence int, is_provisional boolean, section string"))
    got = {(r.dimension, r.key): (r.verified, r.review, r.failed) for r in P.summary(lines, "section").collect()}
    assert got == {("all", ""): (0, 1, 2), ("source_type", "MANUAL"): (0, 1, 0), ("source_type", "UNKNOWN"): (0, 0, 2), ("derivation_type", "none"): (0, 1, 2), ("section", "A"): (0, 1, 1), ("section", None): (0, 0, 1)}
    assert [(r.module, r.n) for r in P.top_reasons(lines).collect()] == [("Integrity", 2), ("RateEvidence", 2), ("Integrity", 1)]
    assert P.summary(lines.limit(0), "section").collect() == [] and P.top_reasons(lines.limit(0)).collect() == []


def test_typed_and_imported(spark):
    one = spark.range(1)
    made = one.select(P.build_manual(F.lit("u"), F.lit("now"), F.lit("why")).alias("m"), P.build_imported(F.lit("supplier-quote"), F.lit("q.pdf"), F.lit("now"), F.lit(None).cast("string")).alias("i"))
    row = made.select(P.parse(F.col("m")).alias("m"), P.parse(F.col("i")).alias("i")).head()
    assert (row.m.sourceType, row.m.confidence, row.m.evidence[0].kind, row.i.sourceType, row.i.evidence[0].kind) == ("MANUAL", 1.0, "user", "IMPORTED", "import")


def test_texts_are_read_once(spark):
    """A payload is parsed once for all its checks (F4, F6, F11, F12, F16, F18, F19), and strictly, with all of the text."""
    lines = spark.range(1).select(F.lit("{}").alias("provenance"), F.lit(0.5).alias("confidence"), F.lit(False).alias("is_provisional"))
    plan = P.audit_lines(lines.repartition(2))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "variant" not in plan.lower()
    good = '{"sourceType":"MANUAL","evidence":[{"kind":"legacy","note":"a \\ud800 b"}],"confidence":1,"evidenceChain":[{"id":"\\ud800","type":"PRIOR","confidence":1,"weight":0.25}]}'
    odd = [good + " tail", good.replace('"MANUAL"', '"MANUAL","sourceType":"MANUAL"'), good.replace("0.25", "NaN"), good.replace("0.25", "true"), "[" * 5000, "", None, "7"]
    got = spark.createDataFrame([(k, t) for k, t in enumerate([good, *odd])], "k int, t string").select("k", P.parse(F.col("t")).alias("p")).orderBy("k").collect()
    assert got[0].p.confidence == 1.0 and got[0].p.evidenceChain[0].weight == 0.25 and got[0].p.evidenceChain[0].id == "?"
    assert all(r.p is None for r in got[1:])


def test_plain_payloads_are_read_together(spark, monkeypatch):
    """payloads as builders write them are parsed by the batch and not one by one; odd ones among them come out as before."""
    plain = '{"sourceType":"MEASURED","evidence":[{"kind":"sheet","sheetId":"s1","pageNo":12,"extractedValue":"19.04","bbox":{"cs":"dxf-mm","x":1,"y":2.5}},{"kind":"legacy","note":"n"}],"confidence":0.5,"evidenceChain":[{"id":"a","type":"PRIOR","confidence":1,"weight":0.5}]}'
    odd = [
        None, "", "{}", "no json", "[1]", plain + "{}", "{}{}", plain[:-1], " " + plain, plain + "\n", plain.replace(",", ",\n"), plain.replace('"confidence":0.5', '"confidence":0.5,"confidence":0.5'), plain.replace('"kind":"legacy"', '"kind":"legacy","kind":"user"'),
        plain.replace("0.5,", "null,"), plain.replace("0.5,", "1.5,"), plain.replace("0.5,", "1e999,"), plain.replace("0.5,", "NaN,"), plain.replace("0.5,", '"0.5",'), plain.replace("12,", "12.5,"), plain.replace("12,", '"12",'), plain.replace('"x":1,', ""), plain.replace("dxf-mm", "miles"),
        plain.replace('"note":"n"', '"pageNo":1.5'), plain.replace('"note":"n"', '"note":"n","pageNo":1.5'), plain.replace('"note":"n"', '"note":"\\ud800 \\u00e9"'), plain.replace('"n"', '"null é \\" \\n"'), plain.replace('"id":"a"', '"id":4'), plain.replace("PRIOR", "GUESS"), plain.replace("MEASURED", "SEEN"),
        plain.replace('"confidence":0.5', '"inputs":[{"name":"a","value":3}]'), plain.replace('"confidence":0.5', '"extra":[{}]'), plain.replace('"confidence":0.5', '"derivationType":"rule"'), plain.replace('"confidence":0.5', '"derivationType":"luck"'), '{"sourceType":"MEASURED","evidence":[]}', '{"sourceType":"x}', '{"a":{}']
    alone = []
    one_by_one = P._payload
    monkeypatch.setattr(P, "_payload", lambda raw: alone.append(raw) or one_by_one(raw))
    for ddl in (P._TYPED, P._PLACED):
        type_ = to_arrow_type(DataType.fromDDL(ddl))
        for texts in (odd, [plain] * 2_000, [*[plain] * 2_000, *odd, *odd], [], [None], *[[x, plain] for x in odd]):
            assert P._payloads(pa.array(texts, pa.string()), type_).to_pylist() == pa.array(map(one_by_one, texts), type_).to_pylist()
        alone.clear()
        P._payloads(pa.array([plain] * 2_000), type_)
        assert alone in ([], [None])


def test_line_payloads_are_built_and_read_once(spark):
    """no second reader of the JSON, for which it was built once more."""
    plan = plans.QUERIES["i09_line_provenance"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "from_json" not in plan


def test_a_text_of_a_batch_is_read_once():
    """items with the same meta share its reading."""
    read = []
    out = P._once(pa.array(["a", None, "b", "a", None, "a"]), lambda x: read.append(x) or x and x + "!", pa.string())
    assert out.to_pylist() == ["a!", None, "b!", "a!", None, "a!"] and sorted(read, key=str) == [None, "a", "b"]
