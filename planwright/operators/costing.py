"""Material costing of spaces: three surfaces per space, priced by material or by default rate."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from planwright.functions.numbers import FLOOR_RATE, WALL_RATE, clean, round2, surface_quantity


def space_measures(spaces: DataFrame) -> DataFrame:
    length, width, height = (clean(F.col(c)) for c in ("length_m", "width_m", "height_m"))
    return spaces.withColumns({"floor_area": length * width, "perimeter": 2 * (length + width), "wall_area": 2 * (length + width) * height})


def surface_lines(spaces: DataFrame, materials: DataFrame) -> DataFrame:
    """A row per surface with quantity and cost; the three roles of a space meet the materials in one join."""
    surface = lambda name, material, area: F.struct(F.lit(name).alias("surface"), F.col(material).alias("material"), F.col(area).alias("area"))
    stacked = space_measures(spaces).select("project_id", "space_no", F.inline(F.array(
        surface("floor", "floor_material", "floor_area"), surface("wall", "wall_material", "wall_area"), surface("ceiling", "ceiling_material", "floor_area"))))
    joined = stacked.join(materials, F.col("material") == F.col("material_id"), "left")
    rate = F.when(F.col("surface") == "wall", F.lit(WALL_RATE)).otherwise(F.lit(FLOOR_RATE))
    quantity = F.when(F.col("material_id").isNotNull(), surface_quantity(F.col("area"), F.col("waste_pct"), F.col("coverage"), F.col("unit"))).otherwise(F.lit(0.0))
    out = joined.withColumn("quantity", quantity)
    return out.withColumn("cost", F.when(F.col("material_id").isNull(), round2(F.col("area") * rate)).otherwise(round2(F.col("quantity") * F.col("unit_price"))))


def cost_by_material(lines: DataFrame) -> DataFrame:
    """Bill per project and material; waste, coverage and rounding apply once, to the summed area."""
    keys = ["project_id", "material_id", "category", "unit", "unit_price", "coverage", "waste_pct"]
    summed = lines.where(F.col("material_id").isNotNull()).groupBy(*keys).agg(
        F.sum(F.col("area").cast("decimal(18,4)")).cast("double").alias("area"), F.count(F.lit(1)).alias("n_surfaces"))
    out = summed.withColumn("quantity", surface_quantity(F.col("area"), F.col("waste_pct"), F.col("coverage"), F.col("unit")))
    return out.withColumn("cost", round2(F.col("quantity") * F.col("unit_price")))


def cost_by_category(bill: DataFrame) -> DataFrame:
    sums = bill.groupBy("project_id", "category").agg(F.sum(F.col("cost").cast("decimal(18,2)")).alias("c"))
    whole = F.sum("c").over(Window.partitionBy("project_id")).cast("double")
    return sums.select("project_id", "category", F.col("c").cast("double").alias("cost"), (F.col("c").cast("double") / F.nullif(whole, F.lit(0.0))).alias("share"))


def project_totals(lines: DataFrame) -> DataFrame:
    area = lambda surface: F.sum(F.when(F.col("surface") == surface, F.col("area").cast("decimal(18,4)"))).cast("double")
    known = F.col("material_id").isNotNull()
    return lines.groupBy("project_id").agg(
        area("floor").alias("floor_area"), area("wall").alias("wall_area"), F.count_if(known).alias("assigned"),
        F.count_if(~known).alias("unassigned"), F.bool_and(known).alias("fully_assigned"))


def project_measures(spaces: DataFrame, floor_rate: float = FLOOR_RATE, wall_rate: float = WALL_RATE) -> DataFrame:
    """(project_id, n_spaces, floor_area, wall_area, ceiling_area, perimeter, floor_cost, wall_cost, total_cost): measures are summed first, so no rounding of a space adds up.

    Measures that are null, negative or no number count as 0; sums are kept to four decimals, costs to two.
    """
    total = lambda c: F.round(F.sum(c), 4).alias(c)
    sums = space_measures(spaces).groupBy("project_id").agg(F.count(F.lit(1)).alias("n_spaces"), total("floor_area"), total("wall_area"), total("perimeter"))
    floor, wall = F.col("floor_area") * floor_rate, F.col("wall_area") * wall_rate
    return sums.select("project_id", "n_spaces", "floor_area", "wall_area", F.col("floor_area").alias("ceiling_area"), "perimeter",
                       round2(floor).alias("floor_cost"), round2(wall).alias("wall_cost"), round2(floor + wall).alias("total_cost"))


def grand_totals(lines: DataFrame) -> DataFrame:
    """(project_id, lines_total, unassigned, unassigned_area, unassigned_amount, grand_total) of surface_lines().

    Surfaces with a material count by the bill of their project and material, the others by default rates, each rounded.
    A project with either has a row.
    """
    number = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c)
    free = lines.where(F.col("material_id").isNull()).groupBy("project_id").agg(
        F.count(F.lit(1)).alias("unassigned"), F.sum(F.col("area").cast("decimal(18,4)")).alias("unassigned_area"), F.sum(F.col("cost").cast("decimal(18,2)")).alias("unassigned_amount"))
    billed = cost_by_material(lines).groupBy("project_id").agg(F.sum(F.col("cost").cast("decimal(18,2)")).alias("lines_total"))
    whole = (F.coalesce("lines_total", F.lit(0)) + F.coalesce("unassigned_amount", F.lit(0))).cast("double").alias("grand_total")
    return billed.join(free, "project_id", "full").select("project_id", number("lines_total"), F.coalesce("unassigned", F.lit(0)).alias("unassigned"), number("unassigned_area"), number("unassigned_amount"), whole)
