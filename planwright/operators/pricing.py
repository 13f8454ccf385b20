"""Unit costs, the rate waterfall and bill totals."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planwright.functions.numbers import round2
from planwright.functions.strings import unit
from planwright.operators.rate_codes import rate_code

#: Surface that assemblies without a category serve, by category; fixed values.
SURFACE = {"WALL_FINISH": "WALL", "PAINT": "WALL", "PLASTER": "WALL", "FLOOR_FINISH": "FLOOR", "SCREED": "FLOOR", "CEILING": "CEILING"}


def unit_costs(components: DataFrame, project_qty: float | None = None) -> DataFrame:
    """Cost of one unit of each assembly: materials by coverage, coats and wastage, labour as it is, tools shared out over the project.

    No coverage counts as 1, a coverage of zero as no material, and tools as nothing where the quantity is not given or zero.
    """
    number = lambda c, none=0.0: F.coalesce(F.col(c).cast("double"), F.lit(none))
    spread = number("unit_price") / F.nullif(number("coverage", 1.0), F.lit(0.0)) * F.coalesce("coats", F.lit(1)) * (1 + number("wastage_pct") / 100)
    tools = number("fixed_cost") / project_qty if project_qty else F.lit(0.0)
    part = F.when(F.col("kind") == "MATERIAL", F.coalesce(spread, F.lit(0.0))).when(F.col("kind") == "LABOR", number("unit_price")).otherwise(tools)
    return components.groupBy("assembly_id").agg(F.sum(part.cast("decimal(28,12)")).cast("double").alias("unit_cost"))


def cost_parts(components: DataFrame, project_qty: Column) -> DataFrame:
    """`components` with label, contribution and tools_skipped: what each adds to one unit, by the rules of unit_costs().

    `project_qty` is the quantity of the component's assembly in the project; where it is null or 0, tools add nothing and
    tools_skipped says so. A null label is the kind; a null kind counts as tools.
    """
    number = lambda c, none=0.0: F.coalesce(F.col(c).cast("double"), F.lit(none))
    spread = number("unit_price") / F.nullif(number("coverage", 1.0), F.lit(0.0)) * F.coalesce("coats", F.lit(1)) * (1 + number("wastage_pct") / 100)
    tool = ~F.coalesce(F.col("kind").isin("MATERIAL", "LABOR"), F.lit(False))
    tools = number("fixed_cost") / F.nullif(project_qty.cast("double"), F.lit(0.0))
    part = F.when(F.col("kind") == "MATERIAL", spread).when(F.col("kind") == "LABOR", number("unit_price")).otherwise(tools)
    return components.withColumns({
        "label": F.coalesce("label", "kind"), "contribution": F.coalesce(part, F.lit(0.0)),
        "tools_skipped": tool & (F.coalesce(project_qty.cast("double"), F.lit(0.0)) == 0)})


def rate_waterfall(lines: DataFrame, assemblies: DataFrame, components: DataFrame, rates: DataFrame) -> DataFrame:
    """`lines` (with org_id, category, unit, finish_code, code, qty) and source, rate and amount.

    An assembly of the category and unit for the finish, the lowest in order; else the only assembly for the surface
    or for anything; else the library's rate of the code, the organisation's before the shared one, if its unit
    agrees; else none. The first two depend on category, unit and finish alone, so they are settled once for each
    combination that occurs and come back to the lines by a small equi-join; no line meets an assembly directly.
    """
    lines = lines.withColumn("u", unit(F.col("unit")))
    keys = lines.select("category", "u", "finish_code").distinct()
    offers = assemblies.join(unit_costs(components), "assembly_id", "left").select(
        "takeoff_category", "applies_to", "output_unit", F.col("finish_code").alias("for_finish"), F.struct("sort_order", "assembly_id", F.coalesce("unit_cost", F.lit(0.0)).alias("cost")).alias("o"))
    own = keys.join(offers, (F.col("takeoff_category") == F.col("category")) & (unit(F.col("output_unit")) == F.col("u")) & (F.col("for_finish").isNull() | (F.col("for_finish") == F.col("finish_code"))))
    own = own.groupBy("category", "u", "finish_code").agg(F.min("o")["cost"].alias("own_rate"))
    surface = F.element_at(F.create_map(*[F.lit(x) for kv in SURFACE.items() for x in kv]), F.col("category"))
    places = keys.select("category", "u").distinct().withColumn("surface", surface).where(F.col("surface").isNotNull())
    loose = places.join(offers.where(F.col("takeoff_category").isNull()), F.col("applies_to").isin("GENERIC") | (F.col("applies_to") == F.col("surface"))).where(unit(F.col("output_unit")) == F.col("u"))
    loose = loose.groupBy("category", "u").agg(F.count(F.lit(1)).alias("n"), F.min("o")["cost"].alias("loose_rate")).where("n = 1").drop("n")
    library = rates.select("org_id", "code", F.struct(unit(F.col("unit")).alias("u"), F.col("rate").cast("double").alias("rate")).alias("r"))
    ours = library.where(F.col("org_id").isNotNull()).withColumnRenamed("r", "ours")
    shared = library.where(F.col("org_id").isNull()).select("code", F.col("r").alias("shared"))
    own = own.select(F.col("category").alias("oc"), F.col("u").alias("ou"), F.col("finish_code").alias("of"), "own_rate")
    out = lines.join(own, (F.col("category") == F.col("oc")) & (F.col("u") == F.col("ou")) & F.col("finish_code").eqNullSafe(F.col("of")), "left").drop("oc", "ou", "of")
    out = out.join(loose, ["category", "u"], "left").join(ours, ["org_id", "code"], "left").join(shared, "code", "left")
    listed = F.coalesce("ours", "shared")
    listed = F.when(listed["u"] == F.col("u"), listed["rate"])
    source = F.when(F.col("own_rate").isNotNull(), "assembly").when(F.col("loose_rate").isNotNull(), "assembly-generic").when(listed.isNotNull(), "rate-library").otherwise("provisional-sum")
    rate = F.coalesce("own_rate", "loose_rate", listed)
    return out.withColumns({"source": source, "rate": rate, "amount": F.coalesce(round2(F.col("qty").cast("double") * rate), F.lit(0.0))})


def bill_totals(lines: DataFrame, by: list[str]) -> DataFrame:
    """Priced and provisional sums and counts; line amounts are rounded before they are summed."""
    amount = (F.col("qty") * F.col("rate")).cast("decimal(18,2)")
    return lines.groupBy(*by).agg(
        F.coalesce(F.sum(F.when(~F.col("is_provisional"), amount)).cast("double"), F.lit(0.0)).alias("priced"),
        F.coalesce(F.sum(F.when(F.col("is_provisional"), F.col("ps_amount"))).cast("double"), F.lit(0.0)).alias("provisional"),
        F.count_if(~F.col("is_provisional")).alias("n_priced"), F.count_if("is_provisional").alias("n_provisional"))


#: Begins the tags of wall features, and the one tag of them that is plain paint; fixed values.
WALL_FEATURE, WALL_PAINT = "WF-", "WF-PAINT"
_LINE_KEYS = ["org_id", "category", "u", "finish_code", "feature", "code"]


def _left(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    """Left join by columns of one name in which null equals null."""
    keys = [F.col(k).alias(f"_{k}") for k in on]
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in on])
    return a.join(b.select(*keys, *[c for c in b.columns if c not in on]), same, "left").drop(*[f"_{k}" for k in on])


def price_bill(lines: DataFrame, assemblies: DataFrame, components: DataFrame, rates: DataFrame) -> DataFrame:
    """`lines` with rate, source, amount, is_provisional and ps_amount, by the whole waterfall.

    Lines have org_id, category, tag, description, unit, finish_code, qty, item_id (null: added by hand), rate, source,
    is_provisional and ps_amount. In order: a line that a services rule priced keeps its rate; an assembly of the
    organisation for the category and unit that is for all finishes or lists the line's, the lowest in sort_order;
    else its only assembly without a category for the surface or for anything; else the library's rate under the
    line's code, the organisation's before the shared one, if the units agree; else the line is provisional. Wall
    features pass over assemblies. A provisional sum typed by hand keeps its amount, others get none.

    What a line gets depends on a few of its fields, so rates are settled once for each combination that occurs and
    joined back once. Assemblies have org_id, takeoff_category, applies_to, output_unit, finish_codes (array, null or
    empty: all) and sort_order; ties go to the smaller assembly_id. Rates are one row an organisation and code.
    """
    code = rate_code(F.col("category"), F.col("tag"), F.col("description"), F.col("unit"))
    feature = F.coalesce((F.col("category") == "WALL_FINISH") & F.col("tag").startswith(WALL_FEATURE) & (F.col("tag") != WALL_PAINT), F.lit(False))
    lines = lines.withColumns({"u": unit(F.coalesce("unit", F.lit(""))), "feature": feature, "code": code})
    keys = lines.select(*_LINE_KEYS).distinct()
    # To six decimals, so that an amount does not hang on the last bit of a sum of quotients.
    cost = unit_costs(components).select("assembly_id", F.round("unit_cost", 6).alias("cost"))
    offers = assemblies.join(cost, "assembly_id", "left").select(
        F.col("org_id").alias("_org"), "takeoff_category", "applies_to", unit(F.coalesce("output_unit", F.lit(""))).alias("_u"), F.coalesce("finish_codes", F.array().cast("array<string>")).alias("finishes"),
        F.struct("sort_order", "assembly_id", F.coalesce("cost", F.lit(0.0)).alias("cost")).alias("o"))
    plain = keys.where(~F.col("feature")).select("org_id", "category", "u", "finish_code").distinct()
    same_org = F.col("org_id").eqNullSafe(F.col("_org")) & (F.col("u") == F.col("_u"))
    fits = (F.size("finishes") == 0) | F.coalesce(F.array_contains("finishes", F.col("finish_code")), F.lit(False))
    own = plain.join(offers, same_org & (F.col("takeoff_category") == F.col("category"))).where(fits).groupBy("org_id", "category", "u", "finish_code").agg(F.min("o").alias("own"))
    surface = F.element_at(F.create_map(*[F.lit(x) for kv in SURFACE.items() for x in kv]), F.col("category"))
    loose = plain.select("org_id", "category", "u").distinct().withColumn("surface", surface).where(F.col("surface").isNotNull())
    loose = loose.join(offers.where(F.col("takeoff_category").isNull()), same_org & ((F.col("applies_to") == "GENERIC") | (F.col("applies_to") == F.col("surface"))))
    loose = loose.groupBy("org_id", "category", "u").agg(F.count(F.lit(1)).alias("n"), F.min("o").alias("loose")).where("n = 1").drop("n")
    listed = rates.select(F.col("org_id").alias("_ro"), F.col("code").alias("_c"), unit(F.coalesce("unit", F.lit(""))).alias("_ru"), F.col("rate").cast("double").alias("_rate"))
    ours = listed.where(F.col("_ro").isNotNull()).select("_ro", "_c", F.struct("_ru", "_rate").alias("ours"))
    shared = listed.where(F.col("_ro").isNull()).select(F.col("_c").alias("_sc"), F.struct("_ru", "_rate").alias("shared"))
    settled = _left(_left(keys, own, ["org_id", "category", "u", "finish_code"]), loose, ["org_id", "category", "u"])
    settled = settled.join(ours, (F.col("org_id") == F.col("_ro")) & (F.col("code") == F.col("_c")), "left").join(shared, F.col("code") == F.col("_sc"), "left")
    built = F.when(~F.col("feature"), F.coalesce("own", "loose"))
    slot = F.coalesce("ours", "shared")
    library = F.when(slot["_ru"] == F.col("u"), slot["_rate"])
    scope = F.when(F.col("ours").isNotNull(), "org").otherwise("global")
    settled = settled.select(
        *_LINE_KEYS, F.coalesce(built["cost"], library).alias("found"),
        F.when(built.isNotNull(), F.concat(F.lit("assembly:"), built["assembly_id"].cast("string"))).when(library.isNotNull(), F.concat_ws(":", F.lit("rate-library"), scope, F.col("code"))).alias("found_source"))
    out = _left(lines, settled, _LINE_KEYS)
    ruled = F.coalesce(F.col("source").startswith("mep-rule:"), F.lit(False))
    rate = F.when(ruled, F.coalesce(F.col("rate").cast("double"), F.lit(0.0))).otherwise(F.col("found"))
    provisional = rate.isNull()
    by_hand = F.col("item_id").isNull() & F.coalesce("is_provisional", F.lit(False))
    amount = F.when(provisional, F.lit(0.0)).otherwise(F.coalesce(F.col("qty").cast("double"), F.lit(0.0)) * rate)
    taken = {
        "rate": rate, "source": F.when(ruled, F.col("source")).when(provisional, "provisional-sum").otherwise(F.col("found_source")), "amount": round2(amount),
        "is_provisional": provisional, "ps_amount": F.when(~ruled & by_hand, F.col("ps_amount"))}
    kept = [c for c in out.columns if c not in (*taken, "u", "feature", "code", "found", "found_source")]
    return out.select(*kept, *[c.alias(n) for n, c in taken.items()])
