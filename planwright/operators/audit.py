"""Audit of bill lines: integrity, confidence and rate evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planwright.functions.numbers import chain_confidence

REVIEW_BELOW = 0.6
#: Weight of each kind of evidence; fixed values.
WEIGHTS = {"EXTRACTION": 0.6, "MEASUREMENT": 0.7, "DERIVATION": 0.5, "ASSUMPTION": 0.8, "PRIOR": 0.5}


def evidence(*steps: tuple[str, Column]) -> Column:
    return F.array(*[F.struct(c.cast("double").alias("confidence"), F.lit(WEIGHTS[kind]).alias("weight"), F.lit(kind).alias("kind")) for kind, c in steps])


def default_chain(basis: Column) -> Column:
    """The evidence that lines of a basis have if nothing else was recorded; fixed values."""
    extracted = lambda c: ("EXTRACTION", F.lit(c))
    ladder = F.when(basis.isin("MEASURED", "VISUAL"), evidence(extracted(0.95))).when(basis.isin("DERIVED", "PARAMETRIC"), evidence(extracted(0.95), ("DERIVATION", F.lit(0.9))))
    guessed = evidence(extracted(0.9), ("PRIOR", F.lit(0.75)), ("ASSUMPTION", F.lit(0.75)))
    return ladder.when(basis.isin("ESTIMATED", "PLACEHOLDER"), guessed).otherwise(evidence(("ASSUMPTION", F.lit(0.5))))


def source_of(basis: Column) -> tuple[Column, Column]:
    """(source type, derivation type) of a basis; an unknown basis counts as an estimate."""
    measured, derived = basis.isin("MEASURED", "VISUAL"), basis.isin("DERIVED", "PARAMETRIC")
    return F.when(measured, "MEASURED").when(derived, "DERIVED").otherwise("ESTIMATED"), F.when(measured, F.lit(None)).when(derived, "formula").otherwise("ai_reasoning")


def weakest(chain: Column) -> Column:
    """Kind of the step with the smallest confidence ** weight."""
    return F.array_min(F.transform(chain, lambda s: F.struct(F.pow(s["confidence"], s["weight"]).alias("c"), s["kind"].alias("kind"))))["kind"]


def audit(lines: DataFrame) -> DataFrame:
    """`lines` (basis, tag, finish_code, status, is_provisional, rate, chain) and confidence, reasons and verdict, the worst of all axes."""
    confidence = chain_confidence(F.col("chain"))
    manual = F.col("status") == "EDITED"
    findings = [
        ("derived without a field", "failed", (F.col("basis") == "DERIVED") & F.col("tag").isNull()),
        ("estimate without a text", "failed", (F.col("basis") == "ESTIMATED") & F.col("finish_code").isNull()),
        ("low confidence", "review", ~manual & ~F.col("is_provisional") & (confidence < REVIEW_BELOW)),
        ("no rate evidence", "review", ~manual & ~F.col("is_provisional") & (F.coalesce(F.col("rate"), F.lit(0)) == 0)),
    ]
    reasons = F.array_compact(F.array(*[F.when(holds, F.lit(reason)) for reason, _, holds in findings]))
    worst = F.greatest(*[F.when(holds, 2 if level == "failed" else 1).otherwise(0) for _, level, holds in findings])
    out = lines.withColumns({"chain_confidence": confidence, "reasons": reasons, "worst": worst})
    return out.withColumn("verdict", F.when(F.col("worst") == 2, "failed").when(F.col("worst") == 1, "review").otherwise("verified")).drop("worst")
