"""Fair claims: who is served next, and claims that are made once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from planwright.sources import snapshots
from planwright.sources.snapshots import Change, Conflict, Snapshot

CLAIMS = "org_id bigint, job_id bigint, turn int, place bigint, tick string"


def due(jobs: DataFrame, now) -> DataFrame:
    return jobs.where((F.col("status") == "QUEUED") & (F.col("scheduled_for").isNull() | (F.col("scheduled_for") <= now)))


def claim_order(jobs: DataFrame, now) -> DataFrame:
    """(org_id, job_id, turn, last_served): due jobs with the turn in which each comes up, as if they were claimed one by one.

    Each claim serves the organisation that was served longest ago (never served first, ties by org_id) and takes its
    oldest job (ties by job_id). So the k-th jobs of all organisations come before any (k+1)-th, in the order of
    last_served and org_id. A window spans one organisation's due jobs.
    """
    served = jobs.groupBy("org_id").agg(F.max("started_at").alias("last_served")).select(F.col("org_id").alias("_org"), "last_served")
    turn = F.row_number().over(Window.partitionBy("org_id").orderBy("created_at", "job_id"))
    ranked = due(jobs, now).select("org_id", "job_id", turn.alias("turn"))
    return ranked.join(served, F.col("org_id").eqNullSafe(F.col("_org"))).select("org_id", "job_id", "turn", "last_served")


def next_claims(jobs: DataFrame, now, n: int) -> DataFrame:
    """The next `n` claims with their place; each organisation's first `n` due jobs are all that can come up, so no more are ranked."""
    first = claim_order(jobs, now).where(F.col("turn") <= n)
    order = [F.col("turn"), F.col("last_served").asc_nulls_first(), F.col("org_id").asc_nulls_first(), F.col("job_id")]
    top = first.orderBy(*order).limit(n)
    return top.withColumn("place", F.row_number().over(Window.orderBy(*order)).cast("long"))  # `n` rows at most


def claim(spark: SparkSession, root: str, jobs: DataFrame, now, n: int, tick: str) -> Snapshot:
    """Commits the next `n` claims of `jobs` that nobody claimed to the table claim under `root`, as the tick named.

    A tick that is sent again claims nothing more. A claimer that another one overtook starts anew from the claims
    that are then in, so no job is claimed twice.
    """
    while True:
        base = snapshots.current(spark, root)
        if tick in base.tokens:
            return base
        taken = snapshots.read(spark, base, "claim").select(F.col("job_id").alias("_taken")) if "claim" in base.tables else None
        free = jobs if taken is None else jobs.join(taken, F.col("job_id") == F.col("_taken"), "left_anti")
        # An organisation's earlier claims count as served, at the tick's time.
        if taken is not None:
            since = snapshots.read(spark, base, "claim").groupBy("org_id").agg(F.count(F.lit(1)).alias("n")).select(F.col("org_id").alias("_o"), "n")
            free = free.join(since, F.col("org_id").eqNullSafe(F.col("_o")), "left").withColumn("started_at", F.when(F.col("n").isNull(), F.col("started_at")).otherwise(now.cast(jobs.schema["started_at"].dataType)))
        rows = next_claims(free, now, n).select("org_id", "job_id", "turn", "place", F.lit(tick).alias("tick"))
        lock = spark.createDataFrame([(0, tick)], "k bigint, tick string")
        try:
            return snapshots.commit(spark, base, {"claim": Change(rows.to(spark.createDataFrame([], CLAIMS).schema), "job_id", 16, False), "lock": Change(lock, "k", 1)}, tick)
        except Conflict:
            continue
