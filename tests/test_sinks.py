"""Ordered text files, colours of patches and layers' roles: order, restarts, ties, nulls and nothing at all."""

import random
import uuid
from collections import Counter

import pytest
from pyspark.sql import functions as F

from planwright.functions import colours
from planwright.operators import layers
from planwright.session import work_dir
from planwright.sources import snapshots, text_sink


@pytest.fixture
def root(spark):
    return f"{work_dir(spark)}/test-dump-{uuid.uuid4().hex}"


def test_lines_come_back_in_order(spark, root, monkeypatch):
    odd = ["", None, "a\nb", "c\\n", "\\", "d\r\ne", " tail ", "日本"]
    rows = [(k, odd[k % 8] if k % 3 else f"line {k}") for k in range(500)]
    mixed = rows[:]
    random.Random(1).shuffle(mixed)
    data = spark.createDataFrame(mixed, "k int, line string").repartition(7)
    publish = snapshots._publish
    monkeypatch.setattr(snapshots, "_publish", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt()))
    with pytest.raises(KeyboardInterrupt):  # dies after its files, before the list
        text_sink.write_lines(data, F.col("line"), [F.col("k")], root, "d", 60)
    assert snapshots.current(spark, root).version == 0
    monkeypatch.setattr(snapshots, "_publish", publish)
    done = text_sink.write_lines(data, F.col("line"), [F.col("k")], root, "d", 60)
    again = text_sink.write_lines(data.limit(3), F.col("line"), [F.col("k")], root, "d", 60)
    assert again.version == done.version == 1
    got = sorted((r.place, r.line) for r in text_sink.read_lines(spark, done).collect())
    assert got == [(k, x or "") for k, x in rows]
    assert text_sink.manifest_json(spark, done).count('"rows"') > 3


def test_no_lines(spark, root):
    done = text_sink.write_lines(spark.createDataFrame([], "k int, line string"), F.col("line"), [F.col("k")], root, "none")
    assert text_sink.read_lines(spark, done).collect() == []


def test_rows_in_ranges_stay_in_their_tasks(spark, root):
    """rows whose tasks are in order are written where they are, in files of the stated size, however many a task has."""
    rows = [(k, f"line {k}") for k in range(1_300)]
    data = spark.createDataFrame(rows, "k int, line string").coalesce(1).select("k", "line")
    done = text_sink.write_lines(data, F.col("line"), [F.col("k")], root, "many", 1, ranged=True)
    assert sorted((r.place, r.line) for r in text_sink.read_lines(spark, done).collect()) == rows
    spread = spark.createDataFrame(rows[::-1], "k int, line string").repartitionByRange(4, "k")
    done = text_sink.write_lines(spread, F.col("line"), [F.col("k")], root + "-spread", "many", 100, ranged=True)
    assert sorted((r.place, r.line) for r in text_sink.read_lines(spark, done).collect()) == rows
    assert max(r.rows for r in snapshots.read(spark, done, "file").collect()) == 100


def plain_modal(pixels):
    def line(p):
        high, low = max(p), min(p)
        return (high > 240 and low > 230) or high < 50 or (0 if high == 0 else (high - low) / high) < 0.08

    kept = [p for p in pixels if not line(p)]
    if not kept:
        return None
    buckets = Counter(tuple(c // 8 for c in p) for p in kept)  # in order of first places
    best = max(buckets, key=lambda b: buckets[b])
    own = [p for p in kept if tuple(c // 8 for c in p) == best]
    return (*[int(sum(p[c] for p in own) / len(own) + 0.5) for c in range(3)], len(kept) / len(pixels))


def test_colours(spark):
    rnd = random.Random(4)
    patches = [[tuple(rnd.choice([0, 10, 60, 63, 120, 200, 245, 255]) for _ in range(3)) for _ in range(rnd.randrange(1, 60))] for _ in range(60)]
    patches += [[], [(255, 255, 255)] * 5, [(0, 0, 0)], [(200, 10, 10), (10, 200, 10)], [(100, 100, 99)] * 3]
    data = spark.createDataFrame([(k, p) for k, p in enumerate(patches)], "k int, p array<struct<r: int, g: int, b: int>>")
    got = {r.k: (r.m and tuple(r.m), r.h) for r in data.select("k", colours.modal_colour(F.col("p")).alias("m"), colours.hatched(F.col("p")).alias("h")).collect()}
    for k, p in enumerate(patches):
        lines = sum(plain_modal([x]) is None for x in p)
        assert got[k] == (plain_modal(p) if p else None, bool(p) and lines / len(p) > 0.4 and lines < len(p))


def test_layers(spark):
    rows = [(1, "A-DOOR", 5, 0, 0, 2), (1, "my-door", 9, 0, 0, 1), (1, "DOOR-B", 9, 0, 0, 1), (1, "DOOR-C", 99, 0, 0, 0), (1, "x-door-empty", 0, 0, 0, 1), (1, "LAMI-A-AREA-IDEN", 4, 0, 4, 0), (1, "A-WALL", 3, 1, 0, None), (None, None, 3, 1, 1, 1), (2, "room", None, 1, 0, 0)]
    data = spark.createDataFrame(rows, "drawing_id int, layer string, entities int, closed_polylines int, texts int, inserts int")
    got = sorted((r.role, r.place, r.layer, r.score) for r in layers.suggestions(data, 2).collect())
    assert got == [("doors", 1, "A-DOOR", 100), ("doors", 2, "DOOR-B", 90), ("roomBounds", 1, "A-WALL", 100), ("roomLabels", 1, "LAMI-A-AREA-IDEN", 90), ("walls", 1, "A-WALL", 100)]
    plan = layers.suggestions(data, 2)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and layers.suggestions(data.limit(0)).collect() == []
