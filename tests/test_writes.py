"""Commits: what readers see while writers write, die, meet and send again; prices one by one against all at once."""

import datetime
import random
import uuid

import pytest
from pyspark.sql import functions as F

from planwright.operators import writes
from planwright.session import work_dir
from planwright.sources import snapshots as S
from planwright.sources.snapshots import Change, Conflict


@pytest.fixture
def root(spark):
    return f"{work_dir(spark)}/test-commits-{uuid.uuid4().hex}"


def table(spark, rows):
    return spark.createDataFrame(rows, "k bigint, x string")


def content(spark, snapshot, name="t"):
    return sorted((r.k, r.x) for r in S.read(spark, snapshot, name).collect())


def test_versions_replace_append_and_stay_readable(spark, root):
    zero = S.current(spark, root)
    assert zero.version == 0 and zero.tables == {}
    one = S.commit(spark, zero, {"t": Change(table(spark, [(k, "a") for k in range(20)]), "k", 4), "log": Change(table(spark, [(0, "first")]), "k", 4, False)})
    some = table(spark, [(k, "b") for k in range(5)])
    touched = tuple(sorted({r[0] for r in some.select(S.bucket_of("k", 4)).collect()}))[:1]
    two = S.commit(spark, S.current(spark, root), {"t": Change(some, "k", 4, True, touched), "log": Change(table(spark, [(1, "second")]), "k", 4, False)})
    assert content(spark, one) == [(k, "a") for k in range(20)] and content(spark, two, "log") == [(0, "first"), (1, "second")]
    inside = {r.k for r in table(spark, [(k, "") for k in range(20)]).where(S.bucket_of("k", 4) == touched[0]).collect()}
    assert content(spark, two) == sorted([(k, "b") for k in inside if k < 5] + [(k, "a") for k in range(20) if k not in inside])
    assert content(spark, S.current(spark, root, 1)) == content(spark, one)
    with pytest.raises(ValueError):
        S.current(spark, root, 9)


def test_a_writer_that_dies_leaves_the_old_version(spark, root, monkeypatch):
    one = S.commit(spark, S.current(spark, root), {"t": Change(table(spark, [(1, "a")]), "k", 2)})
    monkeypatch.setattr(S, "_publish", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt()))
    with pytest.raises(KeyboardInterrupt):
        S.commit(spark, one, {"t": Change(table(spark, [(1, "half")]), "k", 2)})
    monkeypatch.undo()
    assert content(spark, S.current(spark, root)) == [(1, "a")]
    assert S.vacuum(spark, root) == 0 and S.vacuum(spark, root, older_than=0.0) == 1
    assert content(spark, S.current(spark, root)) == [(1, "a")]


def test_writers_of_one_bucket_conflict_and_of_two_do_not(spark, root):
    base = S.commit(spark, S.current(spark, root), {"t": Change(table(spark, [(k, "a") for k in range(8)]), "k", 2)})
    left, right = (tuple(r.k for r in table(spark, [(k, "") for k in range(8)]).where(S.bucket_of("k", 2) == b).collect()) for b in (0, 1))
    rows = lambda keys, x: table(spark, [(k, x) for k in keys])
    S.commit(spark, base, {"t": Change(rows(left, "l"), "k", 2, True, (0,))})
    both = S.commit(spark, base, {"t": Change(rows(right, "r"), "k", 2, True, (1,)), "log": Change(rows([1], "x"), "k", 2, False)})
    assert both.version == 3 and content(spark, both) == sorted([(k, "l") for k in left] + [(k, "r") for k in right])
    with pytest.raises(Conflict):
        S.commit(spark, base, {"t": Change(rows(left, "late"), "k", 2, True, (0,))})
    S.commit(spark, base, {"log": Change(rows([2], "y"), "k", 2, False)})  # appending never conflicts
    assert content(spark, S.current(spark, root), "log") == [(1, "x"), (2, "y")]
    with pytest.raises(Conflict):
        S.commit(spark, S.current(spark, root), {"t": Change(rows(left, "z").withColumn("more", F.lit(1)), "k", 2, True, (0,))})


def test_two_writers_at_once_take_two_versions(spark, root, monkeypatch):
    base = S.commit(spark, S.current(spark, root), {"log": Change(table(spark, [(0, "a")]), "k", 2, False)})
    publish, once = S._publish, []

    def late(session, snapshot):
        if not once:  # another writer takes the version between reading and publishing
            once.append(1)
            S.commit(session, base, {"log": Change(table(session, [(1, "other")]), "k", 2, False)})
        return publish(session, snapshot)

    monkeypatch.setattr(S, "_publish", late)
    done = S.commit(spark, base, {"log": Change(table(spark, [(2, "mine")]), "k", 2, False)})
    assert done.version == 3 and content(spark, done, "log") == [(0, "a"), (1, "other"), (2, "mine")]


def test_a_commit_sent_again_is_one_commit(spark, root):
    for _ in range(2):
        S.commit(spark, S.current(spark, root), {"log": Change(table(spark, [(1, "a")]), "k", 2, False)}, "batch-7")
    assert S.current(spark, root).version == 1 and content(spark, S.current(spark, root), "log") == [(1, "a")]


def test_chunks_go_on_where_a_job_stopped(spark, root, monkeypatch):
    rows = table(spark, [(k, "v") for k in range(40)])
    commit, calls = S.commit, []

    def dies(*args, **options):
        calls.append(1)
        if len(calls) == 3:
            raise KeyboardInterrupt
        return commit(*args, **options)

    monkeypatch.setattr(S, "commit", dies)
    with pytest.raises(KeyboardInterrupt):
        S.commit_in_chunks(spark, root, "t", rows, "k", 8, 4, "job")
    monkeypatch.undo()
    half = S.current(spark, root)
    assert half.version == 2 and 0 < len(content(spark, half)) < 40
    done = S.commit_in_chunks(spark, root, "t", rows, "k", 8, 4, "job")
    assert done.version == 4 and content(spark, done) == [(k, "v") for k in range(40)]


def one_by_one(live, entries):
    live = {k: dict(v) for k, v in live.items()}
    for e in sorted(entries, key=lambda e: e["entry"]):
        key = (e["org_id"], e["material_id"], e["supplier_id"])
        if e["preferred"]:
            for (o, m, s), row in live.items():
                if (o, m) == key[:2] and s != key[2] and not row["deleted"]:
                    row["preferred"] = False
        row = live.setdefault(key, {"preferred": False})
        row.update(price=e["price"], currency=e["currency"], deleted=False)
        if e["preferred"] is not None:
            row["preferred"] = e["preferred"]
    return live


@pytest.mark.parametrize("seed", range(4))
def test_prices_at_once_are_prices_one_by_one(spark, root, seed):
    rnd, live, day = random.Random(seed), {}, datetime.datetime(2024, 1, 1)
    schema = "org_id bigint, material_id bigint, supplier_id bigint, price double, currency string, effective_date timestamp, preferred boolean, entry bigint"
    for batch in range(3):
        entries = [dict(org_id=rnd.choice([None, 1, 2]), material_id=rnd.randrange(4), supplier_id=rnd.randrange(3), price=float(n), currency="AED", effective_date=day, preferred=rnd.choice([None, None, True, False]), entry=100 * batch + n) for n in range(25)]
        live = one_by_one(live, entries)
        writes.enter_prices(spark, root, spark.createDataFrame([tuple(e.values()) for e in entries], schema), f"b{batch}", 4)
        links = [k for k in live if rnd.random() < 0.3]
        if links:
            writes.set_deleted(spark, root, spark.createDataFrame(links, "org_id bigint, material_id bigint, supplier_id bigint"), True, f"d{batch}", 4)
            for k in links:
                live[k]["deleted"] = True
    now = S.current(spark, root)
    got = {(r.org_id, r.material_id, r.supplier_id): dict(preferred=r.preferred, price=r.price, currency=r.currency, deleted=r.deleted) for r in S.read(spark, now, "price").collect()}
    assert got == live
    assert S.read(spark, now, "price_history").count() == 75
    # Sent again, nothing changes.
    assert writes.enter_prices(spark, root, spark.createDataFrame([], schema), "b2", 4).version == now.version


def test_entries_of_other_organisations_are_refused(spark):
    entries = spark.createDataFrame([(1, 10, 5, None), (1, 11, 5, "USD"), (1, 10, 6, None), (None, 12, 7, None)], "org_id bigint, material_id bigint, supplier_id bigint, currency string")
    materials = spark.createDataFrame([(1, 10, "AED"), (2, 11, "AED"), (None, 12, "EUR")], "org_id bigint, material_id bigint, currency string")
    suppliers = spark.createDataFrame([(1, 5), (2, 6), (None, 7), (1, 5)], "org_id bigint, supplier_id bigint")
    got = {(r.material_id, r.supplier_id): (r.currency, r.rejected) for r in writes.admitted(entries, materials, suppliers).collect()}
    assert got == {(10, 5): ("AED", None), (11, 5): ("USD", "materialId does not belong to your organization"), (10, 6): ("AED", "supplierId does not belong to your organization"), (12, 7): ("EUR", None)}


def test_children_of_some_parents_are_replaced(spark, root):
    rows = spark.createDataFrame([(p, c) for p in [1, 2, 3, None] for c in "ab"], "parent bigint, child string")
    S.commit(spark, S.current(spark, root), {"t": Change(rows, "parent", 4)})
    new = spark.createDataFrame([(1, "z"), (None, "n"), (2, "not a parent given")], "parent bigint, child string")
    parents = spark.createDataFrame([(1,), (None,), (7,), (1,)], "parent bigint")
    done = writes.replace_children(spark, root, "t", "parent", parents, new, "r")
    got = sorted(((r.parent or 0), r.child) for r in S.read(spark, done, "t").collect())
    assert got == [(0, "n"), (1, "z"), (2, "a"), (2, "b"), (3, "a"), (3, "b")]


def test_chunks_work_their_rows_out_once(spark, tmp_path):
    """Four commits read the rows that were made once, and a job that is in already makes none."""
    made = spark.sparkContext.accumulator(0)

    def row(k):
        made.add(1)
        return (k, k * 2)

    rows = spark.createDataFrame(spark.sparkContext.parallelize(range(60), 2).map(row), "id bigint, twice bigint")
    root = f"file://{tmp_path}/chunks"
    done = S.commit_in_chunks(spark, root, "line", rows, "id", 8, 4, "job")
    assert sorted(map(tuple, S.read(spark, done, "line").collect())) == [(k, 2 * k) for k in range(60)]
    again = S.commit_in_chunks(spark, root, "line", rows, "id", 8, 4, "job")
    assert made.value == 60 and again.version == done.version == 4
