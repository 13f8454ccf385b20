"""Nulls, ties, repeated rows and empty tables in joins, merges and pairing."""

import random

from pyspark.sql import functions as F

from planwright.operators import reconcile, spatial


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_reconcile_passes_over_read_errors(spark):
    seen = spark.createDataFrame([("a", 2), ("b", 60), ("c", 3), ("e", None)], "tag string, n int")
    read = spark.createDataFrame([("a", 2), ("b", 4), ("d", 1)], "tag string, n int")
    out = {r.tag: (r.value, r.state, r.confidence) for r in reconcile.reconcile_counts(seen, read, ["tag"], "n").collect()}
    assert out == {"a": (2, "agree", 90), "b": (4, "read-only", 50), "c": (3, "seen-only", 70), "d": (1, "read-only", 50), "e": (None, "none", None)}


def test_coverage_with_nulls_and_repeats(spark):
    left = spark.createDataFrame([("a",), ("a",), (None,)], "tag string")
    right = spark.createDataFrame([("b",), (None,)], "tag string")
    assert rows(reconcile.coverage_gaps(left, right, ["tag"])) == [("a", "missing-right"), ("b", "missing-left")]
    assert reconcile.coverage_gaps(left.limit(0), right.limit(0), ["tag"]).isEmpty()


def test_upsert_protects(spark):
    old = spark.createDataFrame([(1, 10, True), (2, 20, False), (3, 30, False)], "id int, qty int, locked boolean")
    new = spark.createDataFrame([(1, 11), (2, 21), (4, 41)], "id int, qty int")
    assert rows(reconcile.upsert(old, new, ["id"], ["qty"], F.col("locked"))) == [(1, 10, "protect"), (2, 21, "update"), (3, 30, "stale"), (4, 41, "insert")]


def test_nearest_across_cells_and_ties(spark):
    schema = "page int, point_id int, x double, y double"
    points = spark.createDataFrame([(1, 1, 8.0, 0.0), (1, 2, -0.1, 0.0), (1, 3, 500.0, 0.0), (2, 4, 10.0, 0.0)], schema)
    labels = spark.createDataFrame([(1, 8, 6.0, 0.0), (1, 7, 10.0, 0.0), (1, 9, 0.0, 0.0)], schema)
    got = {r.point_id: r.label_id for r in spatial.nearest_within(points, labels, 10.0).collect()}
    assert got == {1: 7, 2: 9, 3: None, 4: None}
    assert spatial.nearest_within(points.limit(0), labels, 10.0).isEmpty()


def test_names_taken_once_in_few_rounds(spark, monkeypatch):
    """The choice is that of a plain loop over the ids, dense or sparse, and rounds stay few where many points want the same names."""
    rng = random.Random(5)
    place = lambda: (rng.gauss(0, 60), rng.gauss(0, 60))
    rows = [(page, k, *place()) for page, n in ((1, 1200), (2, 40)) for k in range(n)]
    rows += [(3, k, 7.0, 7.0 + k % 2) for k in range(6)] + [(None, 1, 0.0, 0.0), (4, 2, None, 0.0), (4, 3, 5.0, 5.0), (4, 4, 65.0, 5.0)]
    points, names = [[r for r in rows if (r[1] % 3 == 0) == own] for own in (True, False)]
    want, taken = set(), set()
    for page, k, x, y in sorted((r for r in points if None not in r), key=lambda r: r[:2]):
        near = sorted(((x - a) ** 2 + (y - b) ** 2, m) for p, m, a, b in names if p == page and None not in (a, b) and (p, m) not in taken)
        if near and near[0][0] <= 3600:
            taken.add((page, near[0][1]))
            want.add((page, k, near[0][1], round(near[0][0] ** 0.5, 6)))
    made, write = [], spatial.materialize
    monkeypatch.setattr(spatial, "materialize", lambda df, tag: made.append(tag) or write(df, tag))
    schema = "page int, point_id bigint, x double, y double"
    got = spatial.one_to_one(spark.createDataFrame(points, schema), spark.createDataFrame(names, schema), 60.0).collect()
    assert len(got) == len(want) and {(r.page, r.point_id, r.label_id, round(r.distance, 6)) for r in got} == want
    assert len(made) < 70, len(made)
    assert spatial.one_to_one(spark.createDataFrame([], schema), spark.createDataFrame(names, schema), 60.0).isEmpty()
