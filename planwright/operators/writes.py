"""Writes of the catalogue and of bills as commits: prices with their history, children replaced, deletion and restoring."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from planwright.session import discard, materialize
from planwright.sources import snapshots
from planwright.sources.snapshots import Change, Snapshot

LINK = ["org_id", "material_id", "supplier_id"]
#: Columns of the live price table and of its history.
PRICES = "org_id bigint, material_id bigint, supplier_id bigint, price double, currency string, effective_date timestamp, preferred boolean, deleted boolean"
HISTORY = "org_id bigint, material_id bigint, supplier_id bigint, price double, currency string, effective_date timestamp, entry bigint"


def admitted(entries: DataFrame, materials: DataFrame, suppliers: DataFrame) -> DataFrame:
    """`entries` with the material's currency where they name none, and rejected: why an entry may not be made, or null.

    Materials and suppliers (org_id and id, materials with a currency) of another organisation are refused.
    """
    m = materials.select(F.col("org_id").alias("_mo"), F.col("material_id").alias("_m"), F.col("currency").alias("_currency"))
    s = suppliers.select(F.col("org_id").alias("_so"), F.col("supplier_id").alias("_s")).distinct()
    both = entries.join(m, F.col("org_id").eqNullSafe(F.col("_mo")) & (F.col("material_id") == F.col("_m")), "left").join(s, F.col("org_id").eqNullSafe(F.col("_so")) & (F.col("supplier_id") == F.col("_s")), "left")
    why = F.when(F.col("_m").isNull(), "materialId does not belong to your organization").when(F.col("_s").isNull(), "supplierId does not belong to your organization")
    return both.withColumns({"currency": F.coalesce("currency", "_currency"), "rejected": why}).drop("_mo", "_m", "_currency", "_so", "_s")


def priced(live: DataFrame, entries: DataFrame) -> DataFrame:
    """The live prices after `entries`, as if they came one by one in order of `entry`.

    The last entry of a link gives its price, currency and date and brings back a deleted link. An entry with preferred
    true takes the preference from all other live links of the material; false gives it up, null leaves it. So of a
    material only the last true counts, unless a later entry of that link gave it up.
    """
    said, true = F.col("preferred").isNotNull(), F.col("preferred")
    last = entries.groupBy(*LINK).agg(
        F.max_by(F.struct("price", "currency", "effective_date"), "entry").alias("new"), F.max_by("preferred", F.when(said, F.col("entry"))).alias("said"), F.max(F.when(said, F.col("entry"))).alias("said_at"), F.min("entry").alias("first_at"),
        F.max(F.when(true, F.col("entry"))).alias("true_at"))
    both = live.alias("l").join(last.alias("n"), [F.col(f"l.{k}").eqNullSafe(F.col(f"n.{k}")) for k in LINK], "full")
    links = both.select(*[F.coalesce(f"l.{k}", f"n.{k}").alias(k) for k in LINK], F.struct("l.price", "l.currency", "l.effective_date").alias("old"), "n.new", F.col("l.preferred").alias("was"), "l.deleted", "n.said", "n.said_at", "n.first_at", "n.true_at")
    # The last true of a material is that of one of its links, and these meet once; entries are not gone through again.
    top = F.max(F.when(F.col("true_at").isNotNull(), F.struct("true_at", "supplier_id"))).over(Window.partitionBy(*LINK[:2]))
    rows = links.withColumn("_top", top).select("*", F.col("_top.true_at").alias("chosen_at"), F.col("_top.supplier_id").alias("chosen")).alias("r")
    was_gone = F.coalesce("r.deleted", F.lit(False))
    gone = was_gone & F.col("new").isNull()
    # Only live links lose the preference, so not one that is deleted, or was until after the choice.
    live_then = ~gone & ~(was_gone & (F.col("first_at") > F.col("chosen_at")))
    taken = F.col("chosen_at").isNotNull() & ~F.col("chosen").eqNullSafe(F.col("r.supplier_id")) & live_then & (F.col("said_at").isNull() | (F.col("said_at") < F.col("chosen_at")))
    now = F.coalesce("new", "old")
    preferred = F.when(taken, F.lit(False)).otherwise(F.coalesce("said", "was", F.lit(False)))
    return rows.select(*[f"r.{k}" for k in LINK], *[now[c].alias(c) for c in ("price", "currency", "effective_date")], preferred.alias("preferred"), gone.alias("deleted"))


def enter_prices(spark: SparkSession, root: str, entries: DataFrame, token: str, buckets: int = 16) -> Snapshot:
    """Commits `entries` (org_id, material_id, supplier_id, price, currency, effective_date, preferred, entry) to the tables price and price_history under `root`.

    Links and history change in one commit; only buckets of the materials entered are read and written.
    """
    base = snapshots.current(spark, root)
    if token in base.tokens:
        return base
    # Read from a table of their own by all that follows: what they are made from may be long work.
    entries = materialize(entries, "entries")
    touched = tuple(sorted(r[0] for r in entries.select(snapshots.bucket_of("material_id", buckets)).distinct().collect()))  # at most `buckets` rows
    live = snapshots.read(spark, base, "price", list(touched)) if "price" in base.tables else spark.createDataFrame([], PRICES)
    now = priced(live, entries).to(spark.createDataFrame([], PRICES).schema)
    history = entries.select(*[F.col(c.split()[0]).cast(c.split()[1]) for c in HISTORY.split(", ")])
    try:
        return snapshots.commit(spark, base, {"price": Change(now, "material_id", buckets, True, touched), "price_history": Change(history, "material_id", buckets, False)}, token)
    finally:
        discard(entries)


def set_deleted(spark: SparkSession, root: str, links: DataFrame, deleted: bool, token: str, buckets: int = 16) -> Snapshot:
    """Marks the live prices of `links` (some of the link's columns) as deleted, or brings them back; history stays. Rows are written as they lie in the buckets read."""
    base = snapshots.current(spark, root)
    keys = [k for k in LINK if k in links.columns]
    hit = links.select(*[F.col(k).alias(f"_{k}") for k in keys]).distinct().withColumn("_hit", F.lit(True))
    on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    rows = snapshots.read(spark, base, "price")
    now = rows.join(hit, on, "left").withColumn("deleted", F.when(F.col("_hit"), F.lit(deleted)).otherwise(F.col("deleted"))).select(*rows.columns)
    return snapshots.commit(spark, base, {"price": Change(now, "material_id", buckets, laid=True)}, token)


def replace_children(spark: SparkSession, root: str, name: str, parent: str, parents: DataFrame, new: DataFrame, token: str) -> Snapshot:
    """Commits `new` in place of all children of `parents` in a table that is dealt by `parent`; other parents' buckets are not touched."""
    base = snapshots.current(spark, root)
    table = base.tables[name]
    touched = tuple(sorted(r[0] for r in parents.select(snapshots.bucket_of(parent, table.buckets)).distinct().collect()))  # at most as many rows as buckets
    old = snapshots.read(spark, base, name, list(touched))
    gone = parents.select(F.col(parent).alias("_gone")).distinct()
    rows = old.join(gone, F.col(parent).eqNullSafe(F.col("_gone")), "left_anti").unionByName(new.join(gone, F.col(parent).eqNullSafe(F.col("_gone")), "left_semi"))
    return snapshots.commit(spark, base, {name: Change(rows.to(old.schema), parent, table.buckets, True, touched)}, token)


def latest_history(history: DataFrame) -> DataFrame:
    """The last entry of each link; ties cannot occur, as entries are numbered."""
    newest = Window.partitionBy(*LINK).orderBy(F.desc("entry"))
    return history.withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n")
