"""The write side: edits with a correction log, flags, space sync, bill versions; each gives the new table, not changes in place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planwright.operators.pick import first_by


def apply_edits(items: DataFrame, edits: DataFrame, keys: list[str]) -> DataFrame:
    """`items` after `edits` (keys, new_qty, new_status, new_finish), with qty_changed and finish_changed.

    Where `edits` has has_qty or has_finish, these say which fields an edit sets, and a null then clears the field;
    without them a null leaves its field as it is. A changed quantity is one that differs from what was extracted, a
    changed finish one that differs from the present code; either makes an item EDITED unless the edit names a status.
    Items may have suggested_finish, the code proposed for them. At most one edit for each item; items without one
    stay as they are.
    """
    for flag, field in (("has_qty", "new_qty"), ("has_finish", "new_finish")):
        if flag not in edits.columns:
            edits = edits.withColumn(flag, F.col(field).isNotNull())
    if "suggested_finish" not in items.columns:
        items = items.withColumn("suggested_finish", F.lit(None).cast("string"))
    both = items.join(edits, keys, "left").withColumns({f: F.coalesce(f, F.lit(False)) for f in ("has_qty", "has_finish")})
    qty_changed = F.col("has_qty") & ~F.col("new_qty").eqNullSafe(F.col("qty_ai"))
    finish_changed = F.col("has_finish") & ~F.col("new_finish").eqNullSafe(F.col("finish_code"))
    promoted = F.when(qty_changed | finish_changed, F.lit("EDITED"))
    return both.select(
        *keys, F.when(F.col("has_qty"), F.col("new_qty")).otherwise(F.col("qty_final")).alias("qty_final"), F.when(F.col("has_finish"), F.col("new_finish")).otherwise(F.col("finish_code")).alias("finish_code"),
        F.coalesce("new_status", promoted, "status").alias("status"), qty_changed.alias("qty_changed"), finish_changed.alias("finish_changed"), "qty_ai", "suggested_finish")


def corrections(edited: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, field, before, after): a row for each changed field of apply_edits(); before is what was extracted or suggested."""
    change = lambda field, changed, before, after: F.when(F.col(changed), F.struct(F.lit(field).alias("field"), F.col(before).cast("string").alias("before"), F.col(after).cast("string").alias("after")))
    made = F.array_compact(F.array(change("qtyFinal", "qty_changed", "qty_ai", "qty_final"), change("finish_code", "finish_changed", "suggested_finish", "finish_code")))
    return edited.select(*keys, F.explode(made).alias("c")).select(*keys, "c.*")


def upsert_flags(existing: DataFrame, found: DataFrame) -> DataFrame:
    """Unresolved flags after `found`, with created: one for each project, rule and item; flags of a whole project also go by message.

    Both have project_id, rule, item_no, severity, message; `existing` has resolved, too, and resolved ones stay out.
    """
    keyed = lambda df: df.withColumn("about", F.when(F.col("item_no").isNull(), F.col("message")).otherwise(F.lit("")))
    keys = ["project_id", "rule", "item_no", "about"]
    old = keyed(existing.where(~F.col("resolved"))).groupBy(*keys).agg(F.min(F.struct("severity", "message")).alias("old"))
    new = keyed(found).groupBy(*keys).agg(F.min(F.struct("severity", "message")).alias("new"))
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    both = old.alias("a").join(new.alias("b"), same, "full")
    key = [F.coalesce(f"a.{k}", f"b.{k}").alias(k) for k in keys[:3]]
    now = F.coalesce("new", "old")
    return both.select(*key, now["severity"].alias("severity"), now["message"].alias("message"), F.col("old").isNull().alias("created"))


def sync_spaces(rooms: DataFrame, manual: DataFrame) -> DataFrame:
    """(project_id, name, length, width, height): measured rooms as square spaces of the standard height.

    A name is what stands before the dash; a space made by hand of the same name wins; rooms without an area make none.
    """
    named = rooms.where(F.col("area").isNotNull()).withColumn("name", F.trim(F.split("name", "—")[0]))
    best = first_by(named, ["project_id", "name"], [F.desc("confidence"), F.col("item_no")])
    side = F.greatest(F.lit(0.1), F.sqrt(F.col("area")))
    new = best.join(manual.select("project_id", "name").distinct(), ["project_id", "name"], "left_anti")
    return new.select("project_id", "name", side.alias("length"), side.alias("width"), F.lit(3.0).alias("height"))


def next_version(generated: DataFrame, latest: DataFrame) -> DataFrame:
    """Lines of the next version: the generated ones, and those of `latest` (with version) that were added by hand, without an item."""
    number = latest.groupBy("project_id").agg(F.max("version").alias("last"))
    carried = latest.where(F.col("item_no").isNull()).drop("version").withColumn("carried", F.lit(True))
    lines = generated.withColumn("carried", F.lit(False)).unionByName(carried)
    return lines.join(number, "project_id", "left").withColumn("version", F.coalesce(F.col("last") + 1, F.lit(1))).drop("last")


def sync_by_key(existing: DataFrame, seed: DataFrame, keys: list[str]) -> DataFrame:
    """`seed` and its action, inserted or updated, and the keys that it lacks, deleted; one row for each key on either side."""
    old = existing.select(*keys).distinct().withColumn("old", F.lit(True))
    both = seed.withColumn("new", F.lit(True)).join(old, keys, "full")
    return both.withColumn("action", F.when(F.col("old").isNull(), "inserted").when(F.col("new").isNull(), "deleted").otherwise("updated")).drop("old", "new")


def replace_children(children: DataFrame, new: DataFrame, parents: DataFrame, keys: list[str]) -> DataFrame:
    """`children` with all those of `parents` replaced by `new`."""
    return children.join(parents.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def bill_after(lines: DataFrame, deleted: DataFrame, patches: DataFrame, added: DataFrame, keys: list[str]) -> DataFrame:
    """(project_id, total, lines) after lines are deleted by key, patched (keys, new_qty) and added (project_id, qty, rate)."""
    left = lines.join(deleted.select(*keys).distinct(), keys, "left_anti").join(patches, keys, "left")
    amount = lambda qty: (qty * F.col("rate")).cast("decimal(18,2)").alias("amount")
    rows = left.select("project_id", amount(F.coalesce("new_qty", "qty"))).unionByName(added.select("project_id", amount(F.col("qty"))))
    return rows.groupBy("project_id").agg(F.sum("amount").cast("double").alias("total"), F.count(F.lit(1)).alias("lines"))
