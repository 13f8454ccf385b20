"""Row filters and projections. Each takes and returns DataFrames or Columns; Catalyst pushes them to the scan."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planwright.functions.strings import is_statement

#: Surfaces a material category is used for; fixed values.
USAGE = {
    "tiles": ["floor", "wall"], "marble": ["floor", "wall"], "grout": ["floor", "wall"], "paint": ["wall", "ceiling"], "gypsum": ["ceiling", "wall"],
    "cladding": ["wall"], "glue": ["floor", "wall", "ceiling"], "other": ["floor", "wall", "ceiling"],
}


def tenant(df: DataFrame, org_id, column: str = "org_id", shared: bool = False) -> DataFrame:
    """Rows of one organisation; with `shared`, rows of none as well."""
    own = F.col(column) == org_id
    return df.where(own | F.col(column).isNull() if shared else own)


def all_of(*conditions: Column | None) -> Column:
    """Conjunction in which an absent condition admits every row."""
    return reduce(lambda a, b: a & b, [c for c in conditions if c is not None], F.lit(True))


def listing(df: DataFrame, equal: dict | None = None, order: list[tuple[str, bool]] = (), limit: int | None = None, deleted: str | None = None) -> DataFrame:
    """Rows equal to the values given, ordered with nulls last (first when descending), the first `limit` of them."""
    out = df.where(all_of(*[F.col(k) == v for k, v in (equal or {}).items()], F.col(deleted).isNull() if deleted else None))
    if order:
        out = out.orderBy(*[F.col(c).desc_nulls_first() if down else F.col(c).asc_nulls_last() for c, down in order])
    return out if limit is None else out.limit(limit)


def find_materials(materials: DataFrame, text: str | None = None, category: str | None = None, usage: str | None = None, low: float | None = None,
                   high: float | None = None, active_only: bool = False, text_columns: tuple[str, ...] = ("name", "supplier", "notes")) -> DataFrame:
    serves = [c for c, uses in USAGE.items() if usage in uses]
    return materials.where(all_of(
        F.lower(F.concat_ws(" ", *text_columns)).contains(text.lower()) if text else None,
        F.col("category") == category if category else None,
        F.col("category").isin(serves) if usage else None,
        F.col("unit_price") >= low if low is not None else None,
        F.col("unit_price") <= high if high is not None else None,
        F.col("active") if active_only else None,
    ))


def needs_review(items: DataFrame, flags: DataFrame) -> DataFrame:
    """Estimated items nobody touched, items of low confidence, and items with a flag."""
    flagged = items.join(flags.select("project_id", "item_no").distinct().withColumn("flagged", F.lit(True)), ["project_id", "item_no"], "left")
    doubt = ((F.col("basis") == "ESTIMATED") & (F.col("status") == "AI")) | (F.col("confidence") < 85) | F.col("flagged").isNotNull()
    return flagged.where(doubt).drop("flagged")


def billable_rooms(items: DataFrame) -> DataFrame:
    """Rooms that are no area statements. Labels that are no rooms never become items: see is_not_a_room."""
    return items.where((F.col("category") == "ROOM") & ~is_statement(F.col("description")))


def area_statements(items: DataFrame) -> DataFrame:
    return items.where((F.col("category") == "ROOM") & is_statement(F.col("description")))


def skirtable(items: DataFrame) -> DataFrame:
    """Rooms with a finish of their own that is neither wet nor external, and no stairs or open places by the name before the dash."""
    name = F.split("description", "—")[0]
    open_place = name.rlike(r"(?i)\b(stair|staircase)\b") | name.rlike(r"(?i)\b(balcony|terrace|veranda)\b")
    return items.where((F.col("finish_code") != "") & ~F.col("finish_code").isin("BATHROOM", "ST03") & ~F.coalesce(open_place, F.lit(False)))
