"""Joins that compare two sources, and merges that write one into the other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Counts above this are read errors, and their source is passed over.
MOST = 50


def reconcile_counts(seen: DataFrame, read: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Full outer join of two readings of a count. The second is preferred; counts over MOST count as absent."""
    sane = lambda df, name: df.select(*keys, F.when(F.col(value) <= MOST, F.col(value)).alias(name))
    both = sane(seen, "seen").join(sane(read, "read"), keys, "full_outer")
    state = F.when(F.col("seen").isNull() & F.col("read").isNull(), "none").when(F.col("seen").isNull(), "read-only").when(F.col("read").isNull(), "seen-only")
    state = state.when(F.col("seen") == F.col("read"), "agree").otherwise("disagree")
    sure = {"agree": 90, "disagree": 60, "seen-only": 70, "read-only": 50}
    out = both.withColumns({"value": F.coalesce("read", "seen"), "state": state})
    return out.withColumn("confidence", F.element_at(F.create_map(*[F.lit(x) for kv in sure.items() for x in kv]), F.col("state")))


def coverage_gaps(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that only one side has, by one aggregation over both instead of two anti joins."""
    marked = left.select(*keys, F.lit(0).alias("side")).unionByName(right.select(*keys, F.lit(1).alias("side")))
    return one_sided(marked, F.col("side"), keys)


def one_sided(rows: DataFrame, side: Column, keys: list[str]) -> DataFrame:
    """Keys whose rows are all of one side, 0 the left and 1 the right; rows of any other are of neither."""
    sides = rows.select(*keys, side.alias("_side")).where(F.col("_side").isin(0, 1)).groupBy(*keys).agg(F.min("_side").alias("_low"), F.max("_side").alias("_high")).where("_low = _high")
    return sides.select(*keys, F.when(F.col("_low") == 0, "missing-right").otherwise("missing-left").alias("gap"))


def upsert(current: DataFrame, incoming: DataFrame, keys: list[str], values: list[str], protected: Column) -> DataFrame:
    """The merged snapshot and what became of each key; rows of `current` for which `protected` holds stay as they are."""
    old = current.select(*keys, F.struct(*values).alias("old"), protected.alias("locked"))
    new = incoming.select(*keys, F.struct(*values).alias("new"))
    action = F.when(F.col("new").isNull(), "stale").when(F.col("old").isNull(), "insert").when(F.col("locked"), "protect").otherwise("update")
    both = old.join(new, keys, "full_outer").withColumn("action", action)
    keep = F.when(F.col("action").isin("stale", "protect"), F.col("old")).otherwise(F.col("new"))
    return both.withColumn("row", keep).select(*keys, *[F.col(f"row.{v}").alias(v) for v in values], "action")


def _same_size(a: Column, b: Column) -> Column:
    return F.coalesce(F.abs(a - b) < 0.0001, a.isNull() & b.isNull())


def reconcile_schedules(seen: DataFrame, read: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, width_mm, height_mm, finish_code, basis, confidence, mismatch) of two readings of a schedule, one row a key on each side.

    Where both have a key, the first of count, sizes and finish that differs is the mismatch, the count is the
    read one, and a count above MOST gives way to the other side's; all else is as seen. A key of one side alone stays
    as it is, whatever its count. A null count differs from nothing, a null finish equals an empty one.
    """
    fields = ["n", "width_mm", "height_mm", "finish_code"]
    both = seen.select(*keys, F.struct(*fields).alias("v")).join(read.select(*keys, F.struct(*fields).alias("t")), keys, "full")
    paired = F.col("v").isNotNull() & F.col("t").isNotNull()
    sane = lambda side: F.when(F.col(f"{side}.n") <= MOST, F.col(f"{side}.n"))
    finish = lambda side: F.coalesce(F.col(f"{side}.finish_code"), F.lit(""))
    field = F.when(F.col("v.n") != F.col("t.n"), "count").when(~_same_size(F.col("v.width_mm"), F.col("t.width_mm")), "width_mm")
    field = field.when(~_same_size(F.col("v.height_mm"), F.col("t.height_mm")), "height_mm").when(finish("v") != finish("t"), "finish")
    mismatch = F.when(paired, field)
    row = F.coalesce("v", "t")
    return both.select(
        *keys, F.when(paired, F.coalesce(sane("t"), sane("v"))).otherwise(row["n"]).alias("n"), *[row[f].alias(f) for f in fields[1:]],
        F.when(paired, "MEASURED").when(F.col("v").isNotNull(), "VISUAL").otherwise("PARAMETRIC").alias("basis"),
        F.when(mismatch.isNotNull(), 60).when(paired, 90).when(F.col("v").isNotNull(), 70).otherwise(50).alias("confidence"), mismatch.alias("mismatch"))
