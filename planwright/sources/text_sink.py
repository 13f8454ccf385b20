"""Ordered text files with a manifest: rows in range order over files of a stated size, whole or not at all."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from planwright.session import shuffles_removed
from planwright.sources.snapshots import Change, Snapshot, commit, current, read

#: Lines of a file, more or less: files are cut by range.
LINES = 500_000
#: The task that wrote a file, and its number among those of the task: names have them with five and three digits, or more.
TASK, NUMBER = r"^part-(\d+)-", r"-c(\d+)[^-]*$"
#: What would end a line is written out; the backslash first. Lines hold no NUL characters.
ESCAPES = [("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r")]


def write_lines(rows: DataFrame, line: str, order: list[Column], root: str, token: str, lines: int = LINES, ranged: bool = False) -> Snapshot:
    """Commits the column `line` of `rows` as text under `root`, in the order given, and the list of its files.

    Rows are dealt by range, so file follows file; the list (file, rows, bytes, first: the rows before it) is committed
    last and readers go by it. A dump with the token that is in already is left as it is; one that died left files that
    nothing names. Order must be total for the result to be one. `ranged` says that the rows of each task come before those
    of the next one already: then they stay there, and a task writes as many files as its rows fill.
    """
    spark = rows.sparkSession
    base = current(spark, root)
    if token in base.tokens:
        return base
    folder = f"{root}/text/{token}-{base.version + 1}"
    text = F.coalesce(line, F.lit(""))
    for plain, written in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(written))
    keyed = rows.select(text.alias("value"), *[c.alias(f"_o{k}") for k, c in enumerate(order)])
    keys = [f"_o{k}" for k in range(len(order))]
    dealt = keyed if ranged else keyed.repartitionByRange(1 + rows.count() // lines, *keys)
    with shuffles_removed(spark):
        dealt.sortWithinPartitions(*keys).select("value").write.mode("overwrite").option("maxRecordsPerFile", lines if ranged else 0).text(folder)
    # Counted from what was written, a row a file; line feeds end lines alone.
    files = spark.read.text(folder).select("value", F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_size").alias("bytes"))
    listed = files.groupBy("file").agg(F.count(F.lit(1)).alias("rows"), F.max("bytes").alias("bytes")).orderBy(*[F.regexp_extract("file", part, 1).cast("int") for part in (TASK, NUMBER)]).collect()
    first, out = 0, []
    for r in listed:
        out.append((f"{folder}/{r['file']}", r["rows"], r["bytes"], first))
        first += r["rows"]
    manifest = spark.createDataFrame(out, "file string, rows bigint, bytes bigint, first bigint")
    return commit(spark, base, {"file": Change(manifest, "file", 1)}, token)


def read_lines(spark: SparkSession, snapshot: Snapshot) -> DataFrame:
    """(place, line) of a dump, place counting all lines from 0. A file is read whole, as its lines have no numbers of their own."""
    files = read(spark, snapshot, "file")
    paths = [r["file"] for r in files.select("file").collect()]
    if not paths:
        return spark.createDataFrame([], StructType.fromDDL("place bigint, line string"))
    whole = spark.read.text(paths, wholetext=True).select("value", F.col("_metadata.file_path").alias("path"))
    name = F.element_at(F.split("path", "/"), -1)
    known = files.select(F.element_at(F.split("file", "/"), -1).alias("name"), "rows", "first")
    parts = whole.withColumn("name", name).join(F.broadcast(known), "name").select("first", "rows", F.posexplode(F.split("value", "\n")).alias("k", "line")).where("k < rows")
    line = F.replace("line", F.lit(ESCAPES[0][1]), F.lit("\x00"))
    for plain, written in ESCAPES[1:]:
        line = F.replace(line, F.lit(written), F.lit(plain))
    return parts.select((F.col("first") + F.col("k")).alias("place"), F.replace(line, F.lit("\x00"), F.lit("\\")).alias("line"))


def manifest_json(spark: SparkSession, snapshot: Snapshot) -> str:
    """The list of files as JSON, for those who read without Spark."""
    return json.dumps([r.asDict() for r in read(spark, snapshot, "file").orderBy("first").collect()])
