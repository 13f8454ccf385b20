"""Queue queries: status by payload key, idempotent enqueue, failure propagation."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from planwright.plans.registry import QUERIES, ORACLE_SQL, query
from planwright.operators import claims
from planwright.session import work_dir
from planwright.sources import snapshots
from planwright.streaming.intake import enqueue_once
from planwright.streaming.lifecycle import replayed

_KEYED = ", k AS (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS document_id FROM job)"


def _keyed(v):
    return v("job").withColumn("document_id", F.get_json_object("props", "$.k").cast("long"))


@query("c21_document_jobs", _KEYED + """
SELECT document_id, count(*) AS n, count(*) FILTER (status = 'DONE') AS done, count(*) FILTER (status = 'FAILED') AS failed, count(*) FILTER (status IN ('QUEUED', 'RUNNING')) AS active, max(created_at) AS latest FROM k GROUP BY 1""", ("job",))
def document_jobs(v):
    count = lambda *s: F.count_if(F.col("status").isin(*s))
    return _keyed(v).groupBy("document_id").agg(F.count(F.lit(1)).alias("n"), count("DONE").alias("done"), count("FAILED").alias("failed"), count("QUEUED", "RUNNING").alias("active"), F.max("created_at").alias("latest"))


@query("l06_stage_gate", _KEYED + """
SELECT document_id, event_type, count(*) FILTER (status IN ('QUEUED', 'RUNNING')) = 0 AS complete FROM k GROUP BY 1, 2""", ("job",))
def stage_gate(v):
    return _keyed(v).groupBy("document_id", "event_type").agg((F.count_if(F.col("status").isin("QUEUED", "RUNNING")) == 0).alias("complete"))


@query("l07_failed_documents", _KEYED + """
SELECT document_id, arg_max(job_id, (created_at, job_id)) AS by_job FROM k WHERE status = 'FAILED' AND attempts >= 3 GROUP BY 1""", ("job",))
def failed_documents(v):
    failed = _keyed(v).where("status = 'FAILED' AND attempts >= 3")
    return failed.groupBy("document_id").agg(F.max(F.struct("created_at", "job_id"))["job_id"].alias("by_job"))


QUERIES["l05_enqueue_once"] = lambda spark, sf_dir: enqueue_once(spark, f"{sf_dir}/events.parquet")
ORACLE_SQL["l05_enqueue_once"] = "SELECT DISTINCT user_id, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS document_id FROM events"


#: A run is overdue after six hours: events of one lane are hours apart.
TIMEOUT_S = 6 * 3600


@query("l03_queue_stream", f"""
WITH RECURSIVE e AS (
  SELECT user_id AS job_id, CASE event_type WHEN 'signup' THEN 'enqueue' WHEN 'purchase' THEN 'enqueue' WHEN 'click' THEN 'claim' WHEN 'view' THEN 'done' ELSE event_type END AS event, epoch_us(ts) AS t,
    row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
ends AS (SELECT job_id, 'end' AS event, (SELECT max(t) FROM e) - 1000000 AS t, max(rn) + 1 AS rn FROM e GROUP BY 1),
ev AS (SELECT * FROM e UNION ALL SELECT * FROM ends),
r AS (
  SELECT DISTINCT job_id, CAST(0 AS BIGINT) AS rn, CAST(NULL AS VARCHAR) AS status, 0 AS attempts, CAST(NULL AS BIGINT) AS started, CAST(NULL AS BIGINT) AS due,
    CAST(NULL AS BIGINT) AS t1, CAST(NULL AS VARCHAR) AS change1, CAST(NULL AS VARCHAR) AS status1, 0 AS attempts1, CAST(NULL AS BIGINT) AS t2, CAST(NULL AS VARCHAR) AS change2 FROM e
  UNION ALL
  SELECT job_id, rn, CASE change2 WHEN 'queued' THEN 'QUEUED' WHEN 'claimed' THEN 'RUNNING' WHEN 'done' THEN 'DONE' WHEN 'failed' THEN 'FAILED' WHEN 'retry' THEN 'QUEUED' ELSE s1 END,
    CASE change2 WHEN 'queued' THEN 0 WHEN 'claimed' THEN attempts + 1 ELSE attempts END, CASE WHEN change2 = 'claimed' THEN t WHEN change2 IS NULL AND s1 = 'RUNNING' THEN started END,
    CASE WHEN change2 = 'retry' THEN t + CASE attempts WHEN 1 THEN 4000000 ELSE 8000000 END WHEN change2 IS NULL THEN due1 END, t1, change1, s1, attempts, t, change2
  FROM (SELECT *, CASE WHEN event = 'enqueue' AND (s1 IS NULL OR s1 IN ('DONE', 'FAILED')) THEN 'queued' WHEN event = 'claim' AND s1 = 'QUEUED' AND due1 IS NULL THEN 'claimed' WHEN event = 'done' AND s1 = 'RUNNING' THEN 'done'
      WHEN event = 'error' AND s1 = 'RUNNING' THEN CASE WHEN attempts >= 3 THEN 'failed' ELSE 'retry' END END AS change2
    FROM (SELECT *, CASE WHEN over AND attempts < 3 THEN 'QUEUED' WHEN over THEN 'FAILED' ELSE status END AS s1, CASE WHEN over OR free THEN NULL ELSE due END AS due1,
        CASE WHEN over THEN started + {TIMEOUT_S}000000 WHEN free THEN due END AS t1, CASE WHEN over AND attempts < 3 THEN 'reaped' WHEN over THEN 'timeout' WHEN free THEN 'released' END AS change1
      FROM (SELECT r.job_id, ev.rn, ev.t, ev.event, r.status, r.attempts, r.started, r.due, coalesce(r.status = 'RUNNING' AND r.started + {TIMEOUT_S}000000 < ev.t, FALSE) AS over,
          coalesce(r.status = 'QUEUED' AND r.due <= ev.t, FALSE) AS free FROM r JOIN ev ON ev.job_id = r.job_id AND ev.rn = r.rn + 1) x) y) z)
SELECT job_id, t1 AS at_us, change1 AS change, status1 AS status, attempts1 AS attempts FROM r WHERE change1 IS NOT NULL
UNION ALL SELECT job_id, t2, change2, status, attempts FROM r WHERE change2 IS NOT NULL""")
def queue_stream(v):
    """Every change of every lane's job, from the events replayed as a stream in three micro-batches."""
    return replayed(v("events"), TIMEOUT_S)


_NOW = "2030-01-01"
_ORDER = f"""
, due AS (SELECT *, row_number() OVER (PARTITION BY org_id ORDER BY created_at, job_id) AS turn FROM job WHERE status = 'QUEUED' AND (scheduled_for IS NULL OR scheduled_for <= TIMESTAMP '{_NOW}')),
served AS (SELECT org_id, max(started_at) AS last_served FROM job GROUP BY 1)"""


@query("l02_claim_order", _ORDER + " SELECT org_id, job_id, CAST(turn AS INTEGER) AS turn, last_served FROM due JOIN served USING (org_id)", ("job",))
def claim_order(v):
    return claims.claim_order(v("job"), F.lit(_NOW).cast("timestamp_ntz"))


#: Workers that claim at each tick of the query below.
WORKERS = 200


@query("l02_claims_made", _ORDER + f""",
o AS (SELECT org_id, job_id, turn, last_served, row_number() OVER (ORDER BY turn, last_served NULLS FIRST, org_id NULLS FIRST, job_id) AS place FROM due JOIN served USING (org_id)),
one AS (SELECT * FROM o WHERE place <= {WORKERS}),
rest AS (SELECT o.org_id, o.job_id, row_number() OVER (PARTITION BY o.org_id ORDER BY due.created_at, o.job_id) AS turn, CASE WHEN o.org_id IN (SELECT org_id FROM one) THEN TIMESTAMP '{_NOW}' ELSE last_served END AS last_served
  FROM o JOIN due USING (job_id) WHERE o.place > {WORKERS}),
two AS (SELECT *, row_number() OVER (ORDER BY turn, last_served NULLS FIRST, org_id NULLS FIRST, job_id) AS place FROM rest)
SELECT 'first' AS tick, org_id, job_id, place FROM one UNION ALL SELECT 'second', org_id, job_id, place FROM two WHERE place <= {WORKERS}""", ("job",))
def claims_made(v):
    """The claims of two ticks of 200 workers; the first tick is sent twice and counts once."""
    jobs = v("job")
    spark = jobs.sparkSession
    root, now = f"{work_dir(spark)}/claims-{uuid.uuid4().hex}", F.lit(_NOW).cast("timestamp_ntz")
    for tick in ("first", "first", "second"):
        claims.claim(spark, root, jobs, now, WORKERS, tick)
    return snapshots.read(spark, snapshots.current(spark, root), "claim").select("tick", "org_id", "job_id", "place")
