"""Derived quantities by rules that are rows: measures are taken in one pass over the items, rules are joined to them.

A measure is a row (name, source, value, how): `source` and `value` are SQL over an item's columns, `how` is sum, count
or distinct. A rule is a row (rule_id, measure, factor, category, tag, unit, code, description, reasoning, needs). A new
rule is a new row; a new measure becomes one more aggregate of the same pass. Rules are sent to all tasks, so that projects
are not gathered by their few measures.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planwright.functions.numbers import round2


class Measure(NamedTuple):
    name: str
    source: str
    value: str
    how: str = "sum"


_ROOM = "category = 'ROOM'"
_STAIR = _ROOM + r" AND description RLIKE '(?i)\\bSTAIRCASE\\b'"
#: What the seed rules and the services rules measure. Door columns of a staircase stand for risers and treads.
MEASURES = [
    Measure("STAIR_LM", _STAIR, "CASE WHEN width_mm > 0 THEN door_count * width_mm / 1000 ELSE nullif(door_count * height_mm / 1000, 0) END"),
    Measure("STAIR_LANDING_M2", _STAIR + " AND finish_code IS NOT NULL", "coalesce(qty_final, qty_ai)"),
    Measure("DOOR_WIDTH_LM", "category = 'DOOR'", "door_count * width_mm / 1000"),
    Measure("DOOR_COUNT", "category = 'DOOR'", "door_count"),
    Measure("SERVICES_ITEMS", "category LIKE 'MEP%'", "1", "count"),
]
RULE = "rule_id string, measure string, factor double, category string, tag string, unit string, code string, description string, reasoning string, needs string"
# The seed rules. {qty} stands for the quantity, {n} for the number of items measured, a measure's name for
# its whole amount, and {s:name} for the s of a plural.
RULES = [
    ("sprint1.stair-tread", "STAIR_LM", 1.0, "OTHER", "STAIR-TREAD", "lm", "STAIR-TREAD-LM", "Stair tread (Grainy marble or per finish-plan)", "Σ stair tread length = {qty} lm", None),
    ("sprint1.stair-landing", "STAIR_LANDING_M2", 1.0, "OTHER", "STAIR-LAND", "m²", "STAIR-LAND-M2", "Stair landing finish", "Σ landing area = {qty} m²", None),
    ("sprint1.stair-handrail", "STAIR_LM", 1.0, "JOINERY", "STAIR-HANDRAIL", "rm", "STAIR-HANDRAIL-RM", "Stair handrail (wall-mounted, MDF + natural veneer)", "Handrail length = stair length = {qty} rm", None),
    ("sprint1.door-threshold", "DOOR_WIDTH_LM", 1.0, "OTHER", "THRESHOLD", "lm", "THRESHOLD-LM", "Door threshold (PC-rate, supply only)", "Σ door widths = {qty} lm (across {DOOR_COUNT} door{s:DOOR_COUNT})", None),
    ("sprint1.door-ironmongery", "DOOR_COUNT", 1.0, "OTHER", "IRONMONGERY", "nr", "IRONMONGERY-PC", "Door ironmongery (hardware set per door, PC-rate)", "1 ironmongery set per door × {qty} doors", None),
]


def registry(spark: SparkSession, rows: list[tuple] | None = None) -> DataFrame:
    """Rules as a table; the seed rules if none are given."""
    return spark.createDataFrame(RULES if rows is None else rows, RULE)


def measured(items: DataFrame, measures: list[Measure], by: str = "project_id") -> DataFrame:
    """(by, measure, amount, n, amounts) of every group and measure, from one aggregation; n counts the items with a value, amounts has all measures of the group."""
    columns = []
    for m in measures:
        if m.how not in ("sum", "count", "distinct"):
            raise ValueError(f"{m.name}: unknown aggregate {m.how!r}")
        value = F.when(F.expr(m.source), F.expr(m.value))
        total = {"sum": F.sum(value), "count": F.count(value), "distinct": F.count_distinct(value)}[m.how]
        columns.append(F.struct(F.lit(m.name).alias("measure"), total.cast("double").alias("amount"), F.count(value).alias("n")).alias(f"m{len(columns)}"))
    wide = items.groupBy(by).agg(*columns).withColumn("all", F.array(*[f"m{k}" for k in range(len(columns))]))
    amounts = F.map_from_entries(F.transform("all", lambda m: F.struct(m["measure"], m["amount"])))
    return wide.select(by, amounts.alias("amounts"), F.explode("all").alias("m")).select(by, "m.*", "amounts")


def run_rules(items: DataFrame, rules: DataFrame, measures: list[Measure] | None = None) -> DataFrame:
    """(project_id, rule_id, category, tag, unit, qty, code, description, reasoning): what each rule gives each project.

    A quantity that is null, zero or below gives no row, nor does a rule whose measure nobody takes. A rule with `needs`
    applies only where that measure counts something. Counted units are whole and at least one. Repeated rule rows
    give repeated rows; rules beyond null factors count as factor 1.
    """
    measures = MEASURES if measures is None else measures
    taken = measured(items, measures)
    needed = taken.where("n > 0").select(F.col("project_id").alias("_p"), F.col("measure").alias("_needs"))
    out = taken.join(F.broadcast(rules), "measure").withColumn("raw", F.col("amount") * F.coalesce("factor", F.lit(1.0))).where("raw > 0")
    out = out.join(needed, F.col("project_id").eqNullSafe(F.col("_p")) & (F.col("needs") == F.col("_needs")), "left").where(F.col("needs").isNull() | F.col("_needs").isNotNull())
    whole = F.col("unit").isin("No", "pt", "LS")
    qty = F.when(whole, F.greatest(F.lit(1.0), F.floor(F.col("raw") + 0.5).cast("double"))).otherwise(F.col("raw"))
    shown = F.when(F.col("unit") == "nr", F.floor(F.col("raw")).cast("string")).otherwise(F.format_string("%.2f", round2(F.col("raw"))))
    reasoning = F.replace(F.replace("reasoning", F.lit("{qty}"), shown), F.lit("{n}"), F.col("n").cast("string"))
    for m in measures:
        amount = F.coalesce(F.col("amounts")[m.name], F.lit(0.0))
        reasoning = F.replace(F.replace(reasoning, F.lit(f"{{{m.name}}}"), F.floor(amount).cast("string")), F.lit(f"{{s:{m.name}}}"), F.when(amount == 1, "").otherwise("s"))
    return out.select("project_id", "rule_id", "category", "tag", "unit", qty.alias("qty"), "code", "description", reasoning.alias("reasoning"))
