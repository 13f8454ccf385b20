"""Session settings and the shared work folder."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def build_session(app: str = "planwright", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session with UTC timestamps and adaptive execution; `master` only for local runs."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


#: The folder that local sessions without spark.checkpoint.dir work in; the key is fixed once a session runs.
_LOCAL: list[str] = []
#: Rows that a task gets from dealt_by(), more or less.
DEALT_ROWS = 250_000
#: Folders (and the catalogue's names) of tables that materialize() and bucketed() wrote and nothing deleted yet.
_MADE: dict[str, str | None] = {}


def work_dir(spark: SparkSession) -> str:
    """The folder the cluster shares (spark.checkpoint.dir); a temporary one only for local masters that set none."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith(("local[", "local,")) and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _LOCAL:
            _LOCAL.append("file://" + tempfile.mkdtemp(prefix="planwright-work-"))
        shared = _LOCAL[0]
    return shared.rstrip("/")


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """What is written meanwhile leaves no shuffle files; else they stay until the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def _kept(df: DataFrame, path: str, name: str | None = None) -> DataFrame:
    df._folder, _MADE[path] = path, name
    return df


def materialize(df: DataFrame, tag: str, by: str | None = None) -> DataFrame:
    """Cuts lineage: writes `df` as Parquet under the shared folder, in a directory per value of `by`, and reads it back."""
    spark = df.sparkSession
    path = f"{work_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    with shuffles_removed(spark):
        (df.write.partitionBy(by) if by else df.write).parquet(path)
    schema = df.schema if not by else StructType([f for f in df.schema if f.name != by] + [df.schema[by]])
    return _kept(spark.read.schema(schema).parquet(path), path)


def bucketed(df: DataFrame, n: int, key: str, tag: str) -> DataFrame:
    """Like materialize(), as a table of `n` buckets by `key`: grouping and joining by it needs no shuffle."""
    spark, name = df.sparkSession, f"{tag}_{uuid.uuid4().hex}".replace("-", "_")
    path = f"{work_dir(spark)}/{name}"
    with shuffles_removed(spark):
        df.repartition(n, key).write.bucketBy(n, key).option("path", path).saveAsTable(name)
    return _kept(spark.table(name), path, name)


def folder_of(table: DataFrame) -> str | None:
    """The folder from which a table that materialize() or bucketed() returned is read; None for other tables."""
    return table.__dict__.get("_folder")


def _delete(spark: SparkSession, folder: str) -> None:
    name = _MADE.pop(folder, None)
    if name:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def discard(*tables: DataFrame) -> None:
    """Deletes materialised tables that nothing reads any more."""
    for table in tables:
        folder = folder_of(table)
        if folder:
            _delete(table.sparkSession, folder)


def clear_work(spark: SparkSession) -> int:
    """Deletes every table that this driver materialised and still holds, and says how many; for when its results are stored.

    Lazy results are read from such tables, so their owner calls this and not the query that returns them.
    """
    folders = list(_MADE)
    for folder in folders:
        _delete(spark, folder)
    return len(folders)


def _tasks(df: DataFrame, rows: int) -> int:
    return max(df.sparkSession.sparkContext.defaultParallelism, 1 + rows // DEALT_ROWS)


def dealt_by(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """`df`, of about `rows` rows, dealt by `keys` into tasks of some DEALT_ROWS rows, however large it is.

    What follows may group, join and number by these keys without another exchange.
    """
    return df.repartition(_tasks(df, rows), *keys)


def ranged_by(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """dealt_by() in ranges of `keys`: each task has keys before those of the next one, so what is made of them is in order, too."""
    return df.repartitionByRange(_tasks(df, rows), *keys)


def bound_batches(spark: SparkSession, n_bytes: int = 8 << 20) -> None:
    """Bounds the bytes of an Arrow batch to and from Python, so that memory does not follow the length of texts."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(n_bytes))
