"""Derived quantities, services rules and bill generation from take-off items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from planwright.functions.numbers import aspect_ratio, perimeter, round2, whole_units
from planwright.functions.strings import ceiling_class, lookup, services_key, serial
from planwright.operators.filters import billable_rooms, skirtable

CEILING_HEIGHT = 2.8
SQUARE_FEET = 10.7639
#: Finishes without screed; fixed values.
NO_SCREED = ["ST03", "unassigned"]
#: Bill section by category; fixed values.
SECTIONS = {
    "OTHER": "1.0", "METAL": "2.5", "GRC": "2.5", "JOINERY": "2.6", "MEP_HVAC": "2.7", "MEP_ELEC": "2.71", "MEP_PLUMB": "2.72", "MEP_ELV": "2.73",
    "DOOR": "2.8", "WINDOW": "2.8", "FLOOR_FINISH": "2.9", "WALL_FINISH": "2.9", "CEILING": "2.9", "SCREED": "2.9", "SKIRTING": "2.9", "PAINT": "2.9",
    "PLASTER": "2.9", "BLOCKWORK": "2.9", "WATERPROOFING": "2.9", "SANITARY": "2.9", "EXTERNAL": "3.1", "STRUCTURE_PROV": "4.0", "MEP_PROV": "4.0",
    "STONE_CLADDING": "4.0", "FACADE_SCREEN": "4.0", "HOME_AUTOMATION": "4.0",
}
#: How a category is priced unless its item says otherwise; others are provisional sums. Fixed values.
ESTIMABILITY = {
    "ROOM": "MEASURED", "AREA_STATEMENT": "MEASURED", "DOOR": "MEASURED", "FLOOR_FINISH": "DERIVED", "WALL_FINISH": "DERIVED", "CEILING": "DERIVED",
    "SCREED": "DERIVED", "PAINT": "DERIVED", "PLASTER": "DERIVED", "BLOCKWORK": "DERIVED", "WATERPROOFING": "DERIVED", "SANITARY": "DERIVED", "JOINERY": "LUMP_SUM",
}
#: Allowance of a provisional sum; fixed values.
ALLOWANCES = {"MEP_HVAC": 252000, "MEP_ELEC": 190000, "MEP_PLUMB": 235000, "MEP_ELV": 114000}


def quantity() -> Column:
    return F.coalesce("qty_final", "qty_ai")


def screed(rooms: DataFrame) -> DataFrame:
    """Screeded area of each project, and the finishes counted and left out; staircases and area statements do not count."""
    rooms = billable_rooms(rooms).where(~F.col("description").rlike(r"(?i)\bSTAIRCASE\b"))
    finish = F.coalesce("finish_code", F.lit("unassigned"))
    none = finish.isin(*NO_SCREED)
    names = lambda keep: F.array_join(F.array_sort(F.collect_set(F.when(keep, finish))), ",")
    return rooms.where(quantity() > 0).groupBy("project_id").agg(
        F.coalesce(F.sum(F.when(~none, quantity())), F.lit(0.0)).alias("area"), names(~none).alias("included"), names(none).alias("excluded"))


#: Rooms that the note of a derived row names; fixed value.
NAMED_ROOMS = 8


def floor_groups(rooms: DataFrame) -> DataFrame:
    """(project_id, finish, tag, area, n_rooms, basis, confidence, note): a derived row for each finish of a project's floors.

    Area statements, staircases by the name before the dash and rooms without an area do not count; rooms without a finish
    are one group, by parameter. The note names the first NAMED_ROOMS rooms by item_no, so no more names than that are
    gathered; ties of item_no go by name. Sums are of four decimals; an empty table gives no rows.
    """
    name = F.trim(F.substring_index(F.coalesce("description", F.lit("")), "—", 1))
    each = billable_rooms(rooms.withColumn("description", F.coalesce("description", F.lit("")))).select(
        "project_id", "item_no", F.coalesce("finish_code", F.lit("unassigned")).alias("finish"), quantity().alias("q"), name.alias("name"))
    each = each.where((F.col("q") > 0) & ~F.col("name").rlike(r"(?i)\bSTAIRCASE\b"))
    # Sums combine before the shuffle; of the names only the first few of each group and task move.
    sums = each.groupBy("project_id", "finish").agg(F.sum(F.col("q").cast("decimal(14,4)")).cast("double").alias("area"), F.count(F.lit(1)).alias("n_rooms"))
    place = F.row_number().over(Window.partitionBy("project_id", "finish").orderBy("item_no", "name"))
    first = each.select("project_id", "finish", "item_no", "name").withColumn("place", place).where(F.col("place") <= NAMED_ROOMS)
    names = first.groupBy("project_id", "finish").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "name"))), lambda r: r["name"]), ", ").alias("names"))
    free = F.col("finish") == "unassigned"
    more = F.when(F.col("n_rooms") > NAMED_ROOMS, F.concat(F.lit(", …(+"), (F.col("n_rooms") - NAMED_ROOMS).cast("string"), F.lit(")"))).otherwise("")
    note = F.concat(F.lit("Σ floor area over "), F.col("n_rooms").cast("string"), F.when(F.col("n_rooms") == 1, " room").otherwise(" rooms"), F.lit(" with finish_code="), F.col("finish"), F.lit("; rooms: "), F.col("names"), more)
    return sums.join(names, ["project_id", "finish"]).select(
        "project_id", "finish", F.concat(F.lit("FF-"), "finish").alias("tag"), "area", "n_rooms", F.when(free, "PARAMETRIC").otherwise("DERIVED").alias("basis"), F.when(free, 50).otherwise(85).alias("confidence"), note.alias("note"))


def ceilings(rooms: DataFrame) -> DataFrame:
    classed = billable_rooms(rooms).withColumn("ceiling", ceiling_class(F.col("description"), F.col("finish_code"))).where(F.col("ceiling").isNotNull() & (quantity() > 0))
    return classed.groupBy("project_id", "ceiling").agg(F.sum(quantity()).alias("area"), F.count(F.lit(1)).alias("n"))


def wall_runs(items: DataFrame) -> DataFrame:
    """Skirting length and paint area of each skirtable room, from its area and the usual ratio of its sides."""
    rooms = skirtable(items.where(F.col("category") == "ROOM")).withColumn("area", quantity()).where("area > 0")
    run = perimeter(F.col("area"), aspect_ratio(F.col("description")))
    return rooms.select("project_id", "item_no", round2(run).alias("skirting_m"), round2(run * CEILING_HEIGHT).alias("paint_m2"))


#: Rooms that the services drivers count; fixed values.
DRIVER_ROOMS = {"BATHROOM_COUNT": r"\b(BATH|TOILET|POWDER|WC)\b", "KITCHEN_COUNT": r"\bKITCHEN\b", "BEDROOM_COUNT": r"\bBEDROOM\b"}


def services_drivers(items: DataFrame) -> DataFrame:
    """(project_id, driver, amount): distinct rooms by kind, and the screeded area in square metres and feet.

    Rooms with one key of letters and digits count once; the kind is told from the name before the dash.
    """
    rooms = billable_rooms(items).withColumns({"key": services_key(F.col("description")), "name": F.upper(F.split("description", "—")[0])})
    distinct = lambda pattern: F.count_distinct(F.when(F.col("name").rlike(pattern), F.col("key"))).cast("double")
    area = F.coalesce(F.sum(F.when(~F.coalesce("finish_code", F.lit("unassigned")).isin(*NO_SCREED) & ~F.col("name").rlike(r"\bSTAIRCASE\b"), quantity())), F.lit(0.0))
    wide = rooms.groupBy("project_id").agg(
        F.count_distinct("key").cast("double").alias("ROOM_COUNT"), *[distinct(p).alias(k) for k, p in DRIVER_ROOMS.items()],
        area.alias("AREA_M2"), (area * SQUARE_FEET).alias("AREA_FT2"))
    return wide.unpivot("project_id", ["ROOM_COUNT", *DRIVER_ROOMS, "AREA_M2", "AREA_FT2"], "driver", "amount")


def services_quantities(items: DataFrame, rules: DataFrame) -> DataFrame:
    """Rules applied to the drivers of projects that have a services item; zero quantities are left out."""
    served = items.where(F.col("category").startswith("MEP_")).select("project_id").distinct()
    drivers = services_drivers(items).join(served, "project_id", "left_semi")
    out = drivers.join(rules, "driver").withColumn("raw", F.col("amount") * F.col("factor")).where("raw > 0")
    return out.select("project_id", "rule_id", "driver", whole_units(F.col("raw"), F.col("unit")).alias("qty"))


def generate_bill(items: DataFrame, priced: Column) -> DataFrame:
    """Bill lines by section: priced, provisional sums, lump sums, rate pending, numbered in that order.

    Provisional and lump sums are one line for each category. A window spans one section of one project.
    """
    typed = items.where(F.col("category") != "ROOM").withColumns({
        "section": F.coalesce(lookup(SECTIONS, F.col("category")), F.lit("1.0")),
        "how": F.coalesce(lookup(ESTIMABILITY, F.col("category")), F.lit("PROVISIONAL_SUM")), "qty": quantity()})
    typed = typed.withColumn("bucket", F.when(F.col("how") == "PROVISIONAL_SUM", 2).when(F.col("how") == "LUMP_SUM", 3).when(priced, 1).otherwise(4))
    single = typed.where(F.col("bucket").isin(1, 4)).select("project_id", "section", "bucket", "category", "tag", "item_no", "unit", "qty", F.lit(1).cast("long").alias("n_items"))
    sums = typed.where(F.col("bucket").isin(2, 3)).groupBy("project_id", "section", "bucket", "category").agg(F.count(F.lit(1)).alias("n_items"))
    sums = sums.withColumns({"tag": F.lit(None).cast("string"), "item_no": F.lit(None).cast("long"), "unit": F.lit("LS"), "qty": F.lit(1.0)})
    amounts = F.element_at(F.create_map(*[F.lit(x) for kv in ALLOWANCES.items() for x in kv]), F.col("category"))
    order = Window.partitionBy("project_id", "section").orderBy("bucket", "category", F.asc_nulls_last("tag"), "item_no")
    ref = serial(F.row_number().over(order), 3)
    out = single.unionByName(sums).withColumn("ref", F.concat_ws("/", F.col("section"), ref))
    return out.select("project_id", "ref", "bucket", "category", "item_no", "unit", "qty", "n_items", F.when(F.col("bucket") == 2, amounts).alias("ps_amount"))
