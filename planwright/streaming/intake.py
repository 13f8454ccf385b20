"""Job intake as a stream: each (user, type, document) is queued once, whatever batch brings it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planwright.session import work_dir

KEYS = ["user_id", "event_type", "document_id"]


def requests(events: DataFrame) -> DataFrame:
    """The keys of job requests, on a batch or a stream."""
    return events.select("user_id", "event_type", F.get_json_object("props", "$.k").cast("long").alias("document_id"))


def enqueue_once(spark: SparkSession, path: str) -> DataFrame:
    """Drains the files under `path` through a stream with deduplicated state, and returns what it queued.

    State is one row per key ever queued, dealt by key over the shuffle partitions. The checkpoint and the sink are in
    the shared folder, so a lost executor or a restarted query resumes without queueing a key twice.
    """
    schema = spark.read.parquet(path).schema
    run = f"{work_dir(spark)}/intake-{uuid.uuid4().hex}"
    # The pattern lets a stream read a single file as well as a folder of files.
    stream = requests(spark.readStream.schema(schema).parquet(path[:-1] + "[" + path[-1] + "]")).dropDuplicates(KEYS)
    query = stream.writeStream.format("parquet").option("path", f"{run}/queued").option("checkpointLocation", f"{run}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{run}/queued")
