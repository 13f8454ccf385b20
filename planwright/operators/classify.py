"""Whether a measured line is shown, whether it is priced, and which rate slot prices it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_KEYS = ["category", "rate_code", "rate_hint", "floor_code", "ceiling_code"]


def _slots() -> Column:
    """The codes under which a line may have a rate, in order; nulls are none."""
    floor, skirting = F.col("category") == "FLOOR_FINISH", F.col("category") == "SKIRTING"
    made = lambda prefix, code: F.concat(F.lit(prefix), F.col(code))
    return F.array(
        F.col("rate_code"), F.col("rate_hint"), F.when(floor, made("FF-", "floor_code")), F.when(skirting, made("SK-", "floor_code")), F.when(skirting, F.lit("SKIRTING-LM")),
        F.when(F.col("category") == "CEILING", made("CL-", "ceiling_code")))


def classify_lines(lines: DataFrame, rates: DataFrame, assemblies: DataFrame) -> DataFrame:
    """`lines` with state, is_priced, warning, matched_code and suggested_code.

    `lines` has category, status, qty, rate_code, rate_hint, floor_code and ceiling_code; `rates` (code, rate), one row a
    code; `assemblies` (category), whose lines an assembly prices unless a code or hint of the line itself has a slot.
    Lines beyond the state AI were promoted before and stay. A null quantity counts as 0, a null rate as 0.
    Slots are looked up once for each distinct combination of keys, not for each line.
    """
    keys = lines.where("status = 'AI'").select(*_KEYS).distinct()
    slots = keys.select(*_KEYS, F.posexplode(_slots()).alias("place", "code")).where("code IS NOT NULL")
    priced = slots.join(rates.select("code", F.coalesce("rate", F.lit(0)).alias("rate")), "code").select(*_KEYS, "place", "code", (F.col("rate") > 0).alias("priced"))
    built = keys.join(assemblies.select("category").distinct(), "category", "left_semi").select(*_KEYS, F.lit(1.5).alias("place"), F.lit(None).cast("string").alias("code"), F.lit(True).alias("priced"))
    found = priced.withColumn("place", F.col("place").cast("double")).unionByName(built).groupBy(*_KEYS).agg(F.min(F.struct("place", "code", "priced")).alias("slot"))
    same = [F.col(f"l.{k}").eqNullSafe(F.col(f"s.{k}")) for k in _KEYS]
    both = lines.alias("l").join(found.alias("s"), same, "left").select("l.*", "slot")
    promoted, shown = F.coalesce(F.col("status") != "AI", F.lit(True)), F.coalesce(F.col("qty"), F.lit(0)) > 0
    warned = F.when(F.col("slot").isNull(), "RATE_SLOT_MISSING").when(~F.col("slot.priced"), "RATE_MISSING")
    open_line = ~promoted & shown
    suggestion = F.get(F.filter(_slots(), lambda c: c.isNotNull()), F.lit(0))
    return both.select(
        *[F.col(c) for c in lines.columns], F.when(promoted | shown, "ACTIVE").otherwise("SUPPRESSED").alias("state"),
        (promoted | (open_line & F.coalesce(F.col("slot.priced"), F.lit(False)))).alias("is_priced"), F.when(open_line, warned).alias("warning"),
        F.when(open_line, F.col("slot.code")).alias("matched_code"),
        F.when(open_line & F.col("slot").isNull(), suggestion).when(open_line & ~F.col("slot.priced"), F.col("slot.code")).alias("suggested_code"))
