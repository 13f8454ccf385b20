"""Crop windows, bounded answers, evidence texts and the best reading of a name on a sheet, by given cases and their edges."""

import json

from pyspark.sql import functions as F

from planwright.functions import evidence, vision
from planwright.operators import provenance


def test_crops(spark):
    boxes = [(100.0, 100.0, 130.0, 110.0, 100.0), (100.0, 100.0, 130.0, 110.0, None), (700.0, 500.0, 720.0, 510.0, 0.0), (1500.0, 20.0, 1520.0, 30.0, 20.0), (5000.0, 20.0, 5010.0, 30.0, None)]
    data = spark.createDataFrame([(k, *b) for k, b in enumerate(boxes)], "k int, x_min double, y_min double, x_max double, y_max double, scale double")
    box = F.struct("x_min", "y_min", "x_max", "y_max")

    def plain(b, least):
        x0, y0, x1, y1 = (v * 144 / 72 for v in b[:4])
        margin = max(1500 / b[4] / 25.4 * 144 if b[4] else 0, 300)
        out = []
        for low, high, whole in ((x0, x1, 3000), (y0, y1, 2000)):
            size = max(high - low + 2 * margin, 1200)
            at = max((low + high) / 2 - size / 2, 0)
            size = max(whole - at, 0) if at + size > whole else size
            at, size = int(at + 0.5), int(size + 0.5)
            if least and size < least:
                middle, size = at + size / 2, min(whole, least)
                at = int(max(0, min(whole - size, middle - size / 2)) + 0.5)
            out.append((at, size))
        return (out[0][0], out[1][0], out[0][1], out[1][1])

    for least in (None, 1500):
        got = {r.k: tuple(r.c) for r in data.select("k", vision.crop(box, F.col("scale"), F.lit(144), F.lit(3000), F.lit(2000), least).alias("c")).collect()}
        assert got == {k: plain(b, least) for k, b in enumerate(boxes)}


def test_answers(spark):
    values = [None, float("nan"), float("inf"), -3.0, 0.4, 59.5, 80.0]
    data = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v double").orderBy("k")
    rows = data.select(vision.length(F.col("v")).alias("l"), vision.confidence(F.col("v"), 60, 50).alias("c"), vision.confidence(F.col("v"), 55, 40).alias("w")).collect()
    assert [r.l for r in rows] == [0.0, 0.0, 0.0, 0.0, 0.4, 59.5, 80.0]
    assert [r.c for r in rows] == [50, 50, 50, 0, 0, 60, 60] and [r.w for r in rows] == [40, 40, 40, 0, 0, 55, 55]
    words = spark.createDataFrame([("I",), ("island",), (None,), ("OPEN-ISLAND",)], "x string")
    assert [r[0] for r in words.select(vision.layout(F.col("x"))).collect()] == ["I", "OTHER", "OTHER", "OPEN-ISLAND"]


def test_evidence_texts(spark):
    sheet = {"kind": "sheet", "sheetId": "sheet-123456", "drawingNo": None, "pageNo": 27, "sheetTitle": "DOOR SCHEDULE", "sheetType": "schedule", "sourceDocFilename": "a.pdf", "bbox": {"cs": "pdf-pt", "x": 1.5, "y": 2.4}, "extractedValue": "D" * 70}
    each = [
        (sheet, 'sheet 123456 (DOOR SCHEDULE — schedule) p27 of a.pdf @[2,2] "' + "D" * 60 + '"'), ({"kind": "sheet", "sheetId": "s", "drawingNo": "A1", "pageNo": 0, "sheetTitle": "T"}, "sheet A1 (T)"),
        ({"kind": "document", "documentId": "d", "filename": "f.pdf", "pageNo": 3}, "doc f.pdf p3"), ({"kind": "rateLibrary", "code": "C", "scope": "org", "rate": "1"}, "rate-lib:org:C"), ({"kind": "assembly", "assemblyId": "as-1234567", "brandName": "B"}, "assembly:234567 (B)"),
        ({"kind": "assembly", "assemblyId": "x", "name": "N"}, "assembly:N"), ({"kind": "user", "userId": "user-000042", "at": "2024-01-02T03:04:05Z"}, "user:000042 at 2024-01-02T03:04"), ({"kind": "mepRule", "ruleId": "r", "name": "N", "factorSource": "f" * 90, "rateSource": "r"}, "mep-rule:N · factor: " + "f" * 80 + " · rate: r"),
        ({"kind": "import", "importType": "t", "sourceLabel": "s", "importedAt": "n"}, "import:t from s"), ({"kind": "legacy", "note": "n" * 70}, "legacy: " + "n" * 60)]
    own = {"kind": "takeoffItem", "takeoffItemId": "item-999999", "tag": None, "category": "DOOR"}
    payloads = [{"sourceType": "MEASURED", "evidence": [own, e]} for e, _ in each] + [{"sourceType": "MEASURED", "evidence": [own, own]}, {"sourceType": "MEASURED", "evidence": [own, sheet | {"bbox": {"cs": "px", "x": 1, "y": 1}}]}]
    kinds = [({"derivationType": "formula"}, "(formula not recorded)"), ({"derivationType": "formula", "formula": "f"}, "f"), ({"derivationType": "rule", "ruleRef": "r", "reasoning": "why"}, "why\n  r"), ({"derivationType": "rule"}, ""), ({"derivationType": "ai_reasoning"}, "(reasoning not recorded)"), ({"formula": "f"}, "f"), ({}, "")]
    payloads += [{"sourceType": "DERIVED", "evidence": [own]} | more for more, _ in kinds]
    data = spark.createDataFrame([(k, json.dumps(p)) for k, p in enumerate(payloads)], "k int, t string").orderBy("k").withColumn("v", F.try_parse_json("t")).withColumn("p", provenance.parse_variant(F.col("v")))
    rows = data.select(F.when(F.col("p").isNotNull(), evidence.summary(F.col("v"))).alias("e"), evidence.detail(F.col("p")).alias("d")).collect()
    assert [r.e for r in rows[: len(each)]] == [want for _, want in each]
    assert rows[len(each)].e == "takeoff 999999 (DOOR)" and rows[len(each) + 1].e is None
    assert [r.d for r in rows[len(each) + 2 :]] == [want for _, want in kinds]
