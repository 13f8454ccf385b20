"""The queue as a stream against a plain Python queue, restarts included, and claims against a queue served one by one."""

import datetime
import random
import uuid

import pytest
from pyspark.sql import functions as F

from planwright.operators import claims
from planwright.session import work_dir
from planwright.sources import snapshots
from planwright.streaming import lifecycle as L

SCHEMA = "event_id bigint, ts timestamp, user_id bigint, event_type string"
DAY = datetime.datetime(2024, 1, 1, tzinfo=datetime.UTC)


def made_events(seed, n=400, jobs=12):
    rnd = random.Random(seed)
    kinds = ["signup", "purchase", "click", "click", "view", "error", "error", "other"]
    return [(k, DAY + datetime.timedelta(seconds=rnd.randrange(4000), microseconds=rnd.randrange(1_000_000)), rnd.randrange(jobs), rnd.choice(kinds)) for k in range(n)]


def plain(events, timeout_s, until_us):
    """Every lane by clock: due times are looked at before each event."""
    out = []
    for job in {e[2] for e in events}:
        status, attempts, started, free_at = None, 0, None, None
        mine = sorted((int(e[1].timestamp() * 1_000_000 + 0.5), e[0], e[3]) for e in events if e[2] == job)
        for at, _, kind in [*mine, (until_us, -1, "end")]:
            if status == "RUNNING" and started + timeout_s * 1_000_000 < at:
                status = "QUEUED" if attempts < 3 else "FAILED"
                out.append((job, started + timeout_s * 1_000_000, "reaped" if attempts < 3 else "timeout", status, attempts))
            if status == "QUEUED" and free_at is not None and free_at <= at:
                out.append((job, free_at, "released", status, attempts))
                free_at = None
            change = None
            if kind in ("signup", "purchase") and status in (None, "DONE", "FAILED"):
                status, attempts, change = "QUEUED", 0, "queued"
            elif kind == "click" and status == "QUEUED" and free_at is None:
                status, attempts, started, change = "RUNNING", attempts + 1, at, "claimed"
            elif kind == "view" and status == "RUNNING":
                status, change = "DONE", "done"
            elif kind == "error" and status == "RUNNING" and attempts >= 3:
                status, change = "FAILED", "failed"
            elif kind == "error" and status == "RUNNING":
                status, free_at, change = "QUEUED", at + 2**attempts * 2_000_000, "retry"
            if change:
                out.append((job, at, change, status, attempts))
    return sorted(out)


def until(events):
    return max(int(e[1].timestamp() * 1_000_000 + 0.5) for e in events) - 1_000_000


@pytest.mark.parametrize("cuts", [1, 3])
def test_the_stream_is_the_plain_queue(spark, cuts):
    events = made_events(cuts)
    got = L.replayed(spark.createDataFrame([(*e[:1], e[1], *e[2:]) for e in events], SCHEMA), 90, cuts)
    assert sorted(map(tuple, got.collect())) == plain(events, 90, until(events))


def test_the_batch_is_the_plain_queue(spark):
    events = made_events(7)
    rows = L.job_events(spark.createDataFrame(events, SCHEMA))
    want = plain(events, 90, until(events))
    assert sorted(map(tuple, L.changes_batch(rows, 90, until(events)).collect())) == want
    assert {c[2] for c in want} == {"queued", "claimed", "done", "failed", "retry", "released", "reaped", "timeout"}


def test_a_restarted_stream_goes_on(spark):
    events = sorted(made_events(5), key=lambda e: e[1])
    run = f"{work_dir(spark)}/test-lifecycle-{uuid.uuid4().hex}"
    for k in range(3):
        part = events[k * 150 : (k + 1) * 150]
        L.job_events(spark.createDataFrame(part, SCHEMA)).coalesce(1).write.mode("append").parquet(f"{run}/events")
        L.drain(spark, f"{run}/events", run, 90)
    L.drain(spark, f"{run}/events", run, 90)  # nothing new: nothing more is written
    got = spark.read.schema(L.CHANGES).parquet(f"{run}/changes")
    assert sorted(map(tuple, got.collect())) == plain(events, 90, until(events))


def test_nulls_and_no_events(spark):
    odd = [(1, None, 1, "signup"), (2, DAY, None, "signup"), (3, DAY, 5, None), (4, DAY, 5, "signup"), (4, DAY, 5, "signup")]
    got = L.replayed(spark.createDataFrame(odd, SCHEMA), 90).collect()
    assert [(r.job_id, r.change) for r in got] == [(5, "queued")]
    assert L.replayed(spark.createDataFrame([], SCHEMA), 90).collect() == []


JOB = "org_id bigint, job_id bigint, status string, created_at timestamp, started_at timestamp, scheduled_for timestamp"


def jobs_of(seed):
    rnd = random.Random(seed)
    at = lambda s: DAY + datetime.timedelta(seconds=s)
    return [(rnd.choice([None, 1, 2, 3, 3, 3]), k, rnd.choice(["QUEUED", "QUEUED", "DONE", "RUNNING"]), at(rnd.randrange(30)), rnd.choice([None, at(rnd.randrange(50))]), rnd.choice([None, None, at(10), at(10_000)])) for k in range(60)]


def served_one_by_one(jobs, now):
    """Claims until nothing is due, each an instant after the one before."""
    waiting = {j[1]: j for j in jobs if j[2] == "QUEUED" and (j[5] is None or j[5] <= now)}
    last = {}
    for j in jobs:
        if j[4] is not None:
            last[j[0]] = max(last.get(j[0], j[4]), j[4])
    order, tick = [], 0
    while waiting:
        orgs = {j[0] for j in waiting.values()}
        org = min(orgs, key=lambda o: (o in last, last.get(o, now), o is not None, o or 0))
        job = min((j for j in waiting.values() if j[0] == org), key=lambda j: (j[3], j[1]))
        tick += 1
        last[org] = now + datetime.timedelta(seconds=tick)
        order.append(job[1])
        del waiting[job[1]]
    return order


@pytest.mark.parametrize("seed", range(3))
def test_claims_come_in_the_order_of_a_queue(spark, seed):
    jobs, now = jobs_of(seed), DAY + datetime.timedelta(seconds=100)
    got = claims.next_claims(spark.createDataFrame(jobs, JOB), F.lit(now), 1000).orderBy("place").collect()
    assert [r.job_id for r in got] == served_one_by_one(jobs, now)
    few = claims.next_claims(spark.createDataFrame(jobs, JOB), F.lit(now), 5).orderBy("place").collect()
    assert [r.job_id for r in few] == served_one_by_one(jobs, now)[:5]


def test_no_job_is_claimed_twice(spark, monkeypatch):
    root, now = f"{work_dir(spark)}/test-claims-{uuid.uuid4().hex}", F.lit(DAY + datetime.timedelta(seconds=100))
    jobs = spark.createDataFrame(jobs_of(9), JOB)
    commit, once = snapshots.commit, []

    def overtaken(*args, **options):
        if not once:
            once.append(1)
            claims.claim(spark, root, jobs, now, 4, "other worker")
        return commit(*args, **options)

    monkeypatch.setattr(snapshots, "commit", overtaken)
    claims.claim(spark, root, jobs, now, 4, "tick")
    monkeypatch.undo()
    claims.claim(spark, root, jobs, now, 4, "tick")  # sent again after a restart
    made = snapshots.read(spark, snapshots.current(spark, root), "claim").collect()
    assert len(made) == 8 and len({r.job_id for r in made}) == 8
    for k in range(20):
        claims.claim(spark, root, jobs, now, 5, f"more-{k}")
    made = [r.job_id for r in snapshots.read(spark, snapshots.current(spark, root), "claim").collect()]
    assert sorted(made) == sorted(served_one_by_one(jobs_of(9), DAY + datetime.timedelta(seconds=100)))
