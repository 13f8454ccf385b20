"""Rate codes, vanities, edits, flags, space sync and versions on small tables with nulls, ties and empty inputs."""

from pyspark.sql import functions as F

from planwright.operators import edits, rate_codes, rules


def one(spark, schema, rows, column):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


def test_rate_codes(spark):
    rows = [("FLOOR_FINISH", "ff-st02", "x", "m²"), ("FLOOR_FINISH", None, "x", "m²"), ("DOOR", None, "door 1000 x 3000", "nr"), ("DOOR", "D-1", None, "nr"), ("JOINERY", "KC-1", "", "lm"), ("JOINERY", "kw-2", "", "lm"),
            ("EXTERNAL", None, "", "m²"), ("EXTERNAL", None, "", None), ("WINDOW", "W-1", "", "nr"), ("PAINT", None, None, None), (None, None, None, None), ("OTHER", "thresh", "", "lm")]
    code = rate_codes.rate_code(*map(F.col, ("category", "tag", "description", "unit")))
    want = ["STAIR-LAND", None, "DOOR-1000x3000-FN01", "DOOR-STD-LACQ", None, "KIT-WALL", "EXT-ST03", None, None, "PAINT-INT", None, "THRESH"]
    assert one(spark, "category string, tag string, description string, unit string", rows, code) == want


def test_vanities(spark):
    rows = [("MASTER BATH", "BATHROOM"), ("Bath 02", None), ("ENSUITE", "BATHROOM"), ("SKYLIGHT 04 ABOVE BATH 01", "BATHROOM"), ("BATHING", "ST01"), (None, None), (None, "BATHROOM")]
    assert one(spark, "name string, finish string", rows, rate_codes.vanity(F.col("name"), F.col("finish"))) == [95, 80, 80, None, None, None, 80]


def test_durations(spark):
    assert one(spark, "ms bigint", [(None,), (0,), (999,), (1000,), (59999,), (187000,)], rate_codes.duration_text(F.col("ms"))) == ["—", "0 ms", "999 ms", "1s", "59s", "3m07s"]


def test_placeholders(spark):
    rows = [("PLACEHOLDER rate", []), (None, [None, "a placeholder"]), (None, [None]), ("library", ["quote"])]
    assert one(spark, "source string, evidence array<string>", rows, rate_codes.is_placeholder(F.col("source"), F.col("evidence"))) == [True, True, False, False]


def test_edits(spark):
    items = spark.createDataFrame([(1, 10.0, None, "ST01", "AI"), (2, 5.0, None, None, "AI"), (3, None, 2.0, "PR01", "APPROVED"), (4, 1.0, None, "ST01", "AI")], "item_no int, qty_ai double, qty_final double, finish_code string, status string")
    made = spark.createDataFrame([(1, 10.0, None, "ST01"), (2, 6.0, None, "PR03"), (3, 4.0, "APPROVED", None)], "item_no int, new_qty double, new_status string, new_finish string")
    out = edits.apply_edits(items, made, ["item_no"])
    assert {r.item_no: (r.qty_final, r.finish_code, r.status) for r in out.collect()} == {1: (10.0, "ST01", "AI"), 2: (6.0, "PR03", "EDITED"), 3: (4.0, "PR01", "APPROVED"), 4: (None, "ST01", "AI")}
    assert sorted(map(tuple, edits.corrections(out, ["item_no"]).collect()), key=str) == sorted([(2, "qtyFinal", "5.0", "6.0"), (2, "finish_code", None, "PR03"), (3, "qtyFinal", None, "4.0")], key=str)
    assert edits.apply_edits(items.limit(0), made, ["item_no"]).count() == 0


def test_edits_clear_fields_and_log_the_suggestion(spark):
    items = spark.createDataFrame([(1, 10.0, 3.0, "ST01", "AI", "CT09"), (2, None, None, None, "AI", None)], "item_no int, qty_ai double, qty_final double, finish_code string, status string, suggested_finish string")
    made = spark.createDataFrame([(1, None, None, None, True, True), (2, None, None, None, True, False)], "item_no int, new_qty double, new_status string, new_finish string, has_qty boolean, has_finish boolean")
    out = edits.apply_edits(items, made, ["item_no"])
    assert {r.item_no: (r.qty_final, r.finish_code, r.status) for r in out.collect()} == {1: (None, None, "EDITED"), 2: (None, None, "AI")}
    assert sorted(map(tuple, edits.corrections(out, ["item_no"]).collect())) == [(1, "finish_code", "CT09", None), (1, "qtyFinal", "10.0", None)]


def test_flags(spark):
    schema = "project_id int, rule string, item_no int, severity string, message string"
    old = spark.createDataFrame([(1, "A", 7, "WARN", "x", False), (1, "A", None, "WARN", "8 codes", False), (1, "B", 7, "WARN", "gone", True)], schema + ", resolved boolean")
    new = spark.createDataFrame([(1, "A", 7, "ERROR", "y"), (1, "A", 7, "ERROR", "y"), (1, "A", None, "WARN", "9 codes"), (1, "B", 7, "WARN", "again")], schema)
    out = sorted(map(tuple, edits.upsert_flags(old, new).collect()), key=str)
    assert out == sorted([(1, "A", 7, "ERROR", "y", False), (1, "A", None, "WARN", "8 codes", False), (1, "A", None, "WARN", "9 codes", True), (1, "B", 7, "WARN", "again", True)], key=str)
    assert edits.upsert_flags(old.limit(0), new.limit(0)).count() == 0


def test_spaces_and_versions(spark):
    rooms = spark.createDataFrame([(1, "BED — GF", 1, 50, 9.0), (1, "BED", 2, 50, 16.0), (1, "HALL", 3, 40, None), (1, "BATH", 4, 90, 4.0), (1, "DOT", 5, 9, 0.0)], "project_id int, name string, item_no int, confidence int, area double")
    manual = spark.createDataFrame([(1, "BATH"), (1, "BATH")], "project_id int, name string")
    assert sorted(map(tuple, edits.sync_spaces(rooms, manual).collect())) == [(1, "BED", 3.0, 3.0, 3.0), (1, "DOT", 0.1, 0.1, 3.0)]
    old = spark.createDataFrame([(1, 5, "a", 2), (1, None, "by hand", 2)], "project_id int, item_no int, line string, version int")
    new = spark.createDataFrame([(1, 6, "b"), (2, 1, "first")], "project_id int, item_no int, line string")
    out = sorted((r.project_id, r.line, r.carried, r.version) for r in edits.next_version(new, old).collect())
    assert out == [(1, "b", False, 3), (1, "by hand", True, 3), (2, "first", False, 1)]


def test_projects_are_not_gathered_by_measure(spark):
    """Rules go to the projects: no shuffle deals rows by the few names of measures."""
    items = spark.range(50).selectExpr("id % 7 AS project_id", "'DOOR' AS category", "'x' AS description", "900.0 AS width_mm", "2000.0 AS height_mm", "2 AS door_count", "'ST01' AS finish_code", "1.0 AS qty_final", "1.0 AS qty_ai")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for projects too many to send
    try:
        out = rules.run_rules(items, rules.registry(items.sparkSession))
        assert "hashpartitioning(measure" not in out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert out.count() == 14
