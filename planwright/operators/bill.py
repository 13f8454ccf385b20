"""Bill generation: lines classified, routed by how they can be estimated, collapsed, numbered, and joined by what was typed by hand."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from planwright.functions.strings import lookup, serial
from planwright.operators.classify import classify_lines
from planwright.operators.quantify import ALLOWANCES, ESTIMABILITY, SECTIONS

# Categories that never stand on a bill, services categories, labels of collapsed lines, what an override may say,
# the confidence below which a services rule is a guess, and categories whose lines count as provisional.
NEVER = ["ROOM", "AREA_STATEMENT"]
SERVICES = ["MEP_HVAC", "MEP_ELEC", "MEP_PLUMB", "MEP_ELV"]
LABELS = {"MEP_HVAC": "HVAC", "MEP_ELEC": "Electrical", "MEP_PLUMB": "Plumbing + Drainage", "MEP_ELV": "ELV / Low-current", "JOINERY": "Joinery", "METAL": "Metal works", "GRC": "GRC", "EXTERNAL": "External / Landscape", "SKIRTING": "Skirting",
          "STONE_CLADDING": "Stone cladding", "FACADE_SCREEN": "Façade feature screen", "HOME_AUTOMATION": "Home automation"}
OVERRIDES = ["MEASURED", "DERIVED", "PROVISIONAL", "PLACEHOLDER", "MANUAL"]
GUESS_BELOW = 0.6
PROVISIONAL = ["STRUCTURE_PROV", "MEP_PROV"]
#: The buckets of a section in the order of its lines.
PRICED, SUMS, LUMPS, PENDING, CARRIED = range(1, 6)


def estimability(override: Column, served: Column) -> Column:
    """How an item is estimated: by its project's override, else as a guess, else by its category; services with drawings are derived.

    Reads category, factor_confidence and rate_confidence. Overrides of other words count as none; the override
    PROVISIONAL is no provisional sum. Categories without a default are provisional sums.
    """
    guess = F.coalesce((F.col("factor_confidence") < GUESS_BELOW) & (F.col("rate_confidence") < GUESS_BELOW), F.lit(False))
    usual = F.coalesce(lookup(ESTIMABILITY, F.col("category")), F.lit("PROVISIONAL_SUM"))
    base = F.when(guess, "PLACEHOLDER").otherwise(usual)
    promoted = F.coalesce(served, F.lit(False)) & (base == "PROVISIONAL_SUM") & F.col("category").isin(*SERVICES)
    return F.when(override.isin(*OVERRIDES), override).when(promoted, "DERIVED").otherwise(base)


def _said(kind: str, short: str, set_: str, open_: str) -> Column:
    label = F.coalesce(lookup(LABELS, F.col("category")), F.replace("category", F.lit("_"), F.lit(" ")))
    amount = F.col("ps_amount")
    text = F.when(amount.isNotNull(), F.concat(F.lit(f" ({short} "), F.format_number(amount, 0), F.lit(f" AED, {set_})"))).otherwise(F.lit(f" ({short}, {open_})"))
    items = F.concat(F.lit("; rolled up from "), F.col("n_items").cast("string"), F.lit(" takeoff item"), F.when(F.col("n_items") == 1, "").otherwise("s"))
    return F.concat(label, F.lit(f" — {kind}"), text, items)


def generate(items: DataFrame, rates: DataFrame, assemblies: DataFrame, overrides: DataFrame, served: DataFrame, prior: DataFrame) -> DataFrame:
    """The lines of a new bill version: project_id, section, ref, bucket, category, item_id, description, unit, qty, rate, amount, ps_amount, is_provisional, rate_source, n_items, warning.

    `items` has project_id, item_id, category, tag, description, unit, qty, status, kind (LEGEND: a material's definition,
    no line), rate_code, rate_hint, floor_code, ceiling_code, and of a services rule rule_id, rule_rate,
    factor_confidence and rate_confidence. `rates` and `assemblies` are those of classify_lines(), `overrides`
    (project_id, category, estimability) one row a category, `served` (project_id) the projects with services drawings,
    `prior` (project_id, section, sort_order, description, unit, qty, rate, amount, ps_amount, is_provisional) the lines typed by hand on the version before.

    A section has its priced lines, then one provisional sum and one lump sum for each category of either kind, then
    lines whose rate is pending, then what is carried. Numbers go on from one to the next and are never cut. Guesses,
    items without a category and items that an empty quantity suppresses have no line. A window spans one section of one project.
    """
    shown = items.where(~F.col("category").isin(*NEVER) & ~F.coalesce(F.col("kind") == "LEGEND", F.lit(False)))
    classed = classify_lines(shown, rates, assemblies).where("state = 'ACTIVE'")
    pinned = overrides.groupBy(F.col("project_id").alias("_p"), F.col("category").alias("_c")).agg(F.min("estimability").alias("override"))
    with_plans = served.select(F.col("project_id").alias("_s")).distinct()
    typed = classed.join(pinned, (F.col("project_id") == F.col("_p")) & (F.col("category") == F.col("_c")), "left").join(with_plans, F.col("project_id") == F.col("_s"), "left")
    typed = typed.withColumn("how", estimability(F.col("override"), F.col("_s").isNotNull())).where("how <> 'PLACEHOLDER'")
    bucket = F.when(F.col("how") == "PROVISIONAL_SUM", SUMS).when(F.col("how") == "LUMP_SUM", LUMPS).when(F.col("is_priced"), PRICED).otherwise(PENDING)
    typed = typed.withColumns({"section": F.coalesce(lookup(SECTIONS, F.col("category")), F.lit("1.0")), "bucket": bucket, "qty": F.coalesce(F.col("qty").cast("double"), F.lit(0.0))})
    none = lambda kind: F.lit(None).cast(kind)
    ruled = F.col("rule_id").isNotNull() & F.col("rule_rate").isNotNull() & (F.col("bucket") == PRICED)
    add = F.coalesce(F.concat(F.when(F.col("warning") == "RATE_SLOT_MISSING", " — add ").otherwise(" — populate "), F.col("suggested_code")), F.lit(""))
    prefix = F.concat(F.when(F.col("warning") == "RATE_SLOT_MISSING", "[RATE SLOT MISSING").otherwise("[RATE MISSING"), add, F.lit("] "))
    columns = ["project_id", "section", "bucket", "category", "place", "item_id", "description", "unit", "qty", "rate", "amount", "ps_amount", "is_provisional", "rate_source", "n_items", "warning"]
    single = typed.where(F.col("bucket").isin(PRICED, PENDING)).select(
        "project_id", "section", "bucket", "category", F.struct(F.col("tag").isNull().alias("last"), F.coalesce("tag", F.lit("")).alias("tag"), F.col("item_id").alias("id")).alias("place"), "item_id",
        F.when(F.col("bucket") == PENDING, F.concat(prefix, F.coalesce("description", F.lit("")))).otherwise(F.col("description")).alias("description"), "unit", "qty",
        F.when(ruled, F.col("rule_rate").cast("double")).alias("rate"), F.when(ruled, F.col("qty") * F.col("rule_rate")).alias("amount"), none("double").alias("ps_amount"),
        ((F.col("bucket") == PRICED) & F.col("category").isin(*PROVISIONAL)).alias("is_provisional"), F.when(ruled, F.concat(F.lit("mep-rule:"), F.col("rule_id"))).alias("rate_source"), F.lit(1).cast("long").alias("n_items"),
        F.when(F.col("bucket") == PENDING, F.col("warning")).alias("warning"))
    sums = typed.where(F.col("bucket").isin(SUMS, LUMPS)).groupBy("project_id", "section", "bucket", "category").agg(F.count(F.lit(1)).alias("n_items"))
    sums = sums.withColumn("ps_amount", F.element_at(F.create_map(*[F.lit(x) for kv in ALLOWANCES.items() for x in kv]), F.col("category")).cast("double"))
    said = F.when(F.col("bucket") == SUMS, _said("provisional sum", "P/S", "contractor-typical allowance", "allowance to be confirmed")).otherwise(_said("lump sum", "LS", "supplier-quote allowance", "supplier quote pending"))
    whole = {"place": F.struct(F.lit(False).alias("last"), F.lit("").alias("tag"), none("bigint").alias("id")), "item_id": none("bigint"), "description": said, "unit": F.lit("LS"), "qty": F.lit(1.0), "rate": none("double"),
             "amount": none("double"), "is_provisional": F.lit(True), "rate_source": none("string"), "warning": none("string")}
    by_hand = prior.withColumns({"bucket": F.lit(CARRIED), "category": none("string"), "place": F.struct(F.lit(False).alias("last"), F.coalesce("description", F.lit("")).alias("tag"), F.col("sort_order").cast("bigint").alias("id")), "item_id": none("bigint"),
                                 "rate_source": none("string"), "n_items": F.lit(1).cast("long"), "warning": none("string")})
    kinds = {f.name: f.dataType for f in single.schema}
    alike = lambda df: df.select(*[F.col(c).cast(kinds[c]).alias(c) for c in columns])
    lines = reduce(DataFrame.unionByName, [alike(single), alike(sums.withColumns(whole)), alike(by_hand)])
    order = Window.partitionBy("project_id", "section").orderBy("bucket", F.when(F.col("bucket") == CARRIED, F.col("place.id")), F.col("category").asc_nulls_first(), "place")
    return lines.withColumn("ref", F.concat(F.col("section"), F.lit("/"), serial(F.row_number().over(order), 3))).drop("place")
