"""Line dedup: range-partitioned hashes, first occurrences streamed, run-length keep bitmaps out."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from planwright.llm.quality import line_key
from planwright.llm.text import fingerprint, joined_runs, kept_runs
from planwright.session import materialize

MIN_KEY_CHARS = 10
#: A line key is hot if it makes up more than this share of all lines; so there are at most 1 / share of them.
HOT_SHARE = 0.0002


def line_drops(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, dropped) for documents that lose lines: the numbers of those lines, in order.

    Lines travel as (128 bits of hash, doc_id, place), never as text. They are range-partitioned by hash and
    sorted by hash, document and place; the first row of each hash names the document that keeps the line, and
    all rows of other documents are drops. A hot hash (HOT_SHARE) is counted and given its first document
    with map-side combining beforehand, and its rows never take part in that exchange.
    """
    lines = docs.select("doc_id", fingerprint(F.col("text")).alias("fp"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("pos", "line"))
    keyed = lines.select("doc_id", "fp", "pos", line_key(F.col("line")).alias("key")).where(F.char_length("key") >= MIN_KEY_CHARS)
    # Four passes read these rows; dividing texts and hashing lines is most of the work, so it is done once.
    keyed = materialize(keyed.select("doc_id", "fp", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2")), "line-keys")

    counts = keyed.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id")).alias("first"))
    total = keyed.count()
    hot = counts.where(F.col("n") > max(1000, int(total * HOT_SHARE))).select("h1", "h2", "first")
    marked = keyed.join(F.broadcast(hot), ["h1", "h2"], "left")
    by_hash = Window.partitionBy("h1", "h2").orderBy("doc_id", "pos")
    cold = (
        marked.where(F.col("first").isNull()).drop("first")
        .repartitionByRange("h1", "h2")
        .sortWithinPartitions("h1", "h2", "doc_id", "pos")
        .withColumn("first", F.first(F.struct("doc_id")).over(by_hash))
    )
    drops = marked.where(F.col("first").isNotNull()).unionByName(cold).where(~F.col("first.doc_id").eqNullSafe(F.col("doc_id")))
    return drops.groupBy("doc_id", "fp").agg(F.array_sort(F.collect_set("pos")).alias("dropped"))


def dedup_lines(docs: DataFrame, with_text: bool = True) -> DataFrame:
    """A row per row of `docs`, with n_lines, n_dropped and keep_runs (start and length of kept stretches).

    A line's key is the line without ASCII white space at its ends, A-Z lower-cased. Keys of 10 code points
    or more that two or more doc_ids hold keep their lines in the smallest of these alone. with_text adds
    kept_text and keeps the other columns of `docs`, except those named like a new column; without it only
    doc_id stays. Defined results: a null or empty text is one empty line; a null doc_id counts as the
    smallest; rows with one doc_id are one document; an empty table gives no rows.
    """
    new = ["n_lines", "n_dropped", "keep_runs", "kept_text"]
    docs = docs.select(*[c for c in docs.columns if c not in new])
    gone = line_drops(docs.select("doc_id", "text")).select(F.col("doc_id").alias("_gone_id"), F.col("fp").alias("_gone_fp"), "dropped")
    body = (docs if with_text else docs.select("doc_id", "text")).withColumn("_fp", fingerprint(F.col("text")))
    joined = body.join(gone, F.col("doc_id").eqNullSafe(F.col("_gone_id")) & (F.col("_fp") == F.col("_gone_fp")), "left")
    dropped = F.coalesce("dropped", F.array().cast("array<int>"))
    joined = joined.withColumn("_l", F.split(F.coalesce("text", F.lit("")), "\n")).withColumn("n_dropped", F.size(dropped).cast("long"))
    joined = joined.withColumn("n_lines", F.size("_l").cast("long")).withColumn("keep_runs", kept_runs(dropped, F.size("_l")))
    kept = F.when(F.col("n_dropped") == 0, F.coalesce("text", F.lit(""))).otherwise(joined_runs("_l", F.col("keep_runs")))
    columns = docs.columns if with_text else ["doc_id"]
    return joined.withColumn("kept_text", kept).select(*columns, "n_lines", "n_dropped", "keep_runs", "kept_text")
