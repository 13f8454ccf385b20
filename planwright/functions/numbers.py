"""Rounding, quantity and geometry expressions. All of them are Columns of built-in functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Default rates of surfaces without a material.
FLOOR_RATE, WALL_RATE = 280.0, 180.0
#: (pattern, length to width ratio), first match wins; fixed values.
ASPECT_RATIOS = [
    (r"\b(corridor|passage|hall)\b", 5.0), (r"\b(balcony|terrace|veranda)\b", 3.0), (r"\b(bath|wc|toilet|powder|lavatory|restroom)\b", 1.4),
    (r"\b(kitchen)\b", 1.5), (r"\b(foyer|lobby|entrance)\b", 1.5), (r"\b(garage|driver|maid|laundry|linen|store|storage|utility|mep)\b", 1.3),
    (r"\b(bedroom|bd|guest|master|family|play|dining|dinning|living|sitting|study)\b", 1.4),
]
DEFAULT_RATIO = 1.3


def round2(x: Column) -> Column:
    """Two decimals, halves towards positive infinity."""
    return F.floor(x * 100 + 0.5) / 100


def clean(x: Column) -> Column:
    """A measure: null, NaN and negative values count as 0."""
    return F.greatest(F.coalesce(F.nanvl(x.cast("double"), F.lit(0.0)), F.lit(0.0)), F.lit(0.0))


def in_units(quantity: Column, unit: Column) -> Column:
    """Bags and pieces are bought whole, other units to two decimals."""
    return F.when(unit.isin("bag", "piece"), F.ceil(quantity).cast("double")).otherwise(round2(quantity))


def surface_quantity(area: Column, waste_pct: Column, coverage: Column, unit: Column) -> Column:
    need = area * (1 + waste_pct / 100)
    return F.when(coverage > 0, in_units(need / coverage, unit)).otherwise(F.lit(0.0))


def percent_change(first: Column, last: Column) -> Column:
    return F.when(first > 0, round2((last - first) / first * 100)).otherwise(F.lit(0.0))


def trend(pct: Column, band: float = 1.5) -> Column:
    return F.when(F.abs(pct) < band, "stable").when(pct > 0, "up").otherwise("down")


def aspect_ratio(name: Column) -> Column:
    ladder = F.lit(DEFAULT_RATIO)
    for pattern, ratio in reversed(ASPECT_RATIOS):
        ladder = F.when(name.rlike("(?i)" + pattern), F.lit(ratio)).otherwise(ladder)
    return ladder


def perimeter(area: Column, ratio: Column) -> Column:
    return 2 * (F.sqrt(area * ratio) + F.sqrt(area / ratio))


def whole_units(quantity: Column, unit: Column) -> Column:
    """Counted units are at least 1 and whole, others have two decimals."""
    return F.when(unit.isin("No", "pt", "LS"), F.greatest(F.lit(1.0), F.floor(quantity + 0.5).cast("double"))).otherwise(round2(quantity))


def normal_confidence(c: Column) -> Column:
    return F.when(c <= 1, c).otherwise(c / 100)


def chain_confidence(chain: Column) -> Column:
    """Product of confidence ** weight over an array of structs; 1 for none. Both are clamped."""
    factor = lambda s: F.pow(F.least(F.greatest(s["confidence"], F.lit(1e-6)), F.lit(1.0)), F.least(F.greatest(s["weight"], F.lit(0.0)), F.lit(1.0)))
    return F.aggregate(chain, F.lit(1.0), lambda a, s: a * factor(s))


def quotation_total(subtotal: Column, discount: Column, vat_pct: Column) -> Column:
    return (subtotal - discount) * (1 + vat_pct / 100)


def within_percent(value: Column, truth: Column, percent: float) -> Column:
    return F.abs(value - truth) <= F.abs(truth) * percent / 100


def backoff_seconds(attempt: Column, base: int = 2) -> Column:
    return (F.pow(F.lit(2.0), attempt) * base).cast("long")
