"""Writes as commits in the shared folder, and what a reader finds after them."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from planwright.operators import writes
from planwright.plans.registry import query
from planwright.session import work_dir
from planwright.sources import snapshots
from planwright.sources.snapshots import Change


def _root(spark) -> str:
    return f"{work_dir(spark)}/commits-{uuid.uuid4().hex}"


def _entered(v):
    """The root after all price entries came in as two commits, even orders first."""
    entries = v("price_entry")
    spark = entries.sparkSession
    root = _root(spark)
    for batch in (0, 1):
        writes.enter_prices(spark, root, entries.where(F.col("batch") == batch).drop("batch"), f"entries-{batch}")
    return spark, root


_LIVE = """
, e AS (SELECT *, row_number() OVER (ORDER BY batch, entry) AS pos FROM price_entry),
c AS (SELECT org_id, material_id, max(pos) FILTER (preferred) AS chosen_at, arg_max(supplier_id, pos) FILTER (preferred) AS chosen FROM e GROUP BY ALL),
l AS (SELECT org_id, material_id, supplier_id, arg_max(price, pos) AS price, arg_max(currency, pos) AS currency, max(pos) FILTER (preferred IS NOT NULL) AS said_at, arg_max(preferred, pos) FILTER (preferred IS NOT NULL) AS said, max(pos) AS last_at FROM e GROUP BY ALL),
live AS (SELECT l.*, CASE WHEN chosen_at IS NOT NULL AND chosen <> supplier_id AND (said_at IS NULL OR said_at < chosen_at) THEN FALSE ELSE coalesce(said, FALSE) END AS preferred FROM l JOIN c USING (org_id, material_id))"""


@query("k03_entered_prices", _LIVE + " SELECT org_id, material_id, supplier_id, price, currency, preferred FROM live", ("price_entry",), dealt=True)
def entered_prices(v):
    """Live prices after all entries: the last entry of a link, and at most one preferred link of a material in an organisation."""
    spark, root = _entered(v)
    return snapshots.read(spark, snapshots.current(spark, root), "price").select("org_id", "material_id", "supplier_id", "price", "currency", "preferred")


@query("k03_price_history", _LIVE + """
, h AS (SELECT org_id, material_id, supplier_id, count(*) AS n_entries FROM price_entry GROUP BY ALL)
SELECT h.*, live.price AS last_price FROM h JOIN live USING (org_id, material_id, supplier_id)""", ("price_entry",), dealt=True)
def price_history(v):
    """The history keeps every entry; its last one of a link is the live price."""
    spark, root = _entered(v)
    history = snapshots.read(spark, snapshots.current(spark, root), "price_history")
    order = F.struct((F.floor(F.col("entry") / 10) % 2).alias("batch"), "entry")
    return history.groupBy("org_id", "material_id", "supplier_id").agg(F.count(F.lit(1)).alias("n_entries"), F.max_by("price", order).alias("last_price"))


@query("k04_restored_prices", _LIVE + " SELECT org_id, material_id, supplier_id, supplier_id % 3 = 0 AND supplier_id % 2 <> 0 AS deleted FROM live", ("price_entry",), dealt=True)
def restored_prices(v):
    """Links of every third supplier are deleted, and those of the even ones among them brought back."""
    spark, root = _entered(v)
    gone = v("supplier_d").where("supplier_id % 3 = 0").select("supplier_id")
    writes.set_deleted(spark, root, gone, True, "delete")
    writes.set_deleted(spark, root, gone.where("supplier_id % 2 = 0"), False, "restore")
    return snapshots.read(spark, snapshots.current(spark, root), "price").select("org_id", "material_id", "supplier_id", "deleted")


@query("k05_committed_components", """
SELECT assembly_id, kind, CAST(unit_price AS DOUBLE) AS unit_price FROM assembly_component WHERE assembly_id % 7 <> 0
UNION ALL SELECT assembly_id, kind, CAST(unit_price AS DOUBLE) * 2 FROM assembly_component WHERE assembly_id % 7 = 0 AND kind = 'MATERIAL'""", ("assembly_component",))
def committed_components(v):
    """Every seventh assembly gets its materials anew at twice the price and loses all other components."""
    rows = v("assembly_component").select("assembly_id", "kind", F.col("unit_price").cast("double").alias("unit_price"))
    spark = rows.sparkSession
    root = _root(spark)
    snapshots.commit(spark, snapshots.current(spark, root), {"component": Change(rows, "assembly_id")}, "first")
    parents = rows.where("assembly_id % 7 = 0").select("assembly_id")
    new = rows.where("assembly_id % 7 = 0 AND kind = 'MATERIAL'").withColumn("unit_price", F.col("unit_price") * 2)
    writes.replace_children(spark, root, "component", "assembly_id", parents, new, "second")
    return snapshots.read(spark, snapshots.current(spark, root), "component")


@query("k10_chunked_lines", "SELECT project_id, item_no, CAST(CAST(qty * rate AS DECIMAL(18,2)) AS DOUBLE) AS amount, CASE WHEN is_provisional THEN 'P/S' ELSE 'priced' END AS kind FROM boq_line", ("boq_line",))
def chunked_lines(v):
    """Bill lines with their amounts, written in four commits of a quarter of the projects each."""
    lines = v("boq_line").select("project_id", "item_no", (F.col("qty") * F.col("rate")).cast("decimal(18,2)").cast("double").alias("amount"), F.when(F.col("is_provisional"), "P/S").otherwise("priced").alias("kind"))
    spark = lines.sparkSession
    root = _root(spark)
    done = snapshots.commit_in_chunks(spark, root, "line", lines, "project_id", 16, 4, "price")
    return snapshots.read(spark, done, "line")
