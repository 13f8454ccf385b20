"""First-match, survivor and trend picks by window or ordered minimum. Every order is total."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from planwright.functions.numbers import percent_change, round2, trend


def first_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key."""
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where(F.col("_rank") == 1).drop("_rank")


def procurement(prices: DataFrame) -> DataFrame:
    """Cheapest and preferred live price of each material, and what the cheapest saves where both are in one currency.

    One aggregation with map-side combining: ordered minima of structs instead of a window over all prices.
    """
    row = F.struct("price", "supplier_id", "currency")
    best = prices.groupBy("material_id").agg(
        F.min(row).alias("cheapest"), F.min(F.when(F.col("preferred"), row)).alias("own"), F.count(F.lit(1)).alias("n_prices"))
    amount = F.col("own.price") - F.col("cheapest.price")
    comparable = (F.col("own.currency") == F.col("cheapest.currency")) & (F.col("own.supplier_id") != F.col("cheapest.supplier_id")) & (amount > 0)
    return best.select(
        "material_id", "n_prices", F.col("cheapest.supplier_id").alias("cheapest_supplier"), F.col("cheapest.price").alias("cheapest_price"),
        F.col("own.supplier_id").alias("preferred_supplier"), F.col("own.price").alias("preferred_price"),
        F.when(comparable, round2(amount)).alias("saving"), F.when(comparable, round2(amount / F.col("own.price") * 100)).alias("saving_pct"))


def price_trend(snapshots: DataFrame, keys: list[str]) -> DataFrame:
    """First and last price by date, change in percent and its direction; one aggregation, no window."""
    row = F.struct("effective_date", "seq", "seq2", "supplier_id", "price")
    ends = snapshots.groupBy(*keys).agg(F.min(row).alias("a"), F.max(row).alias("b"), F.count(F.lit(1)).alias("n"))
    pct = percent_change(F.col("a.price"), F.col("b.price"))
    return ends.select(*keys, F.col("a.price").alias("first_price"), F.col("b.price").alias("last_price"), "n", pct.alias("pct"), trend(pct).alias("trend"))


def survivors(items: DataFrame, keys: list[str], score: Column, tie: list[Column], donate: list[str]) -> DataFrame:
    """The best row of each key; its null attributes are filled from the best other row that has them."""
    by = Window.partitionBy(*keys).orderBy(score.desc(), *tie)
    rest = by.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    out = items.withColumn("_rank", F.row_number().over(by))
    for c in donate:
        out = out.withColumn(f"_{c}", F.first(c, ignorenulls=True).over(rest))
    out = out.withColumn("n_rows", F.count(F.lit(1)).over(Window.partitionBy(*keys))).where("_rank = 1")
    return out.withColumns({c: F.col(f"_{c}") for c in donate}).drop("_rank", *[f"_{c}" for c in donate])


def authoritative(items: DataFrame, keys: list[str], score: Column, tie: list[Column], authority: Column) -> DataFrame:
    """The best row of keys that have an authoritative row; all rows of other keys."""
    out = items.withColumn("_has", F.max(authority.cast("int")).over(Window.partitionBy(*keys)))
    out = out.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(score.desc(), *tie)))
    return out.where((F.col("_has") == 0) | (F.col("_rank") == 1)).drop("_has", "_rank")
