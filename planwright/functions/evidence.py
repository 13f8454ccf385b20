"""Evidence and derivation of a provenance payload as the texts of an export."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _text(e: Column, field: str) -> Column:
    """A text field; null if it is empty, too."""
    x = F.try_variant_get(e, f"$.{field}", "string")
    return F.when(x != "", x)


def _or_end(e: Column, field: str, of: str) -> Column:
    """A field, or the last six characters of another one."""
    return F.coalesce(F.try_variant_get(e, f"$.{field}", "string"), F.right(F.try_variant_get(e, f"$.{of}", "string"), F.lit(6)))


def _join(*parts: Column) -> Column:
    return F.concat(*[F.coalesce(p, F.lit("")) for p in parts])


def _page(e: Column) -> Column:
    n = F.try_variant_get(e, "$.pageNo", "bigint")
    return F.when(n != 0, F.concat(F.lit(" p"), n.cast("string")))


def _whole(e: Column, field: str) -> Column:
    return F.floor(F.try_variant_get(e, f"$.{field}", "double") + 0.5).cast("string")


def describe(e: Column) -> Column:
    """One piece of evidence (VARIANT) as text; the formats are fixed values."""
    lit = F.lit
    kind = F.try_variant_get(e, "$.kind", "string")
    title = _text(e, "sheetTitle")
    titled = F.concat(lit(" ("), title, F.coalesce(F.concat(lit(" — "), _text(e, "sheetType")), lit("")), lit(")"))
    box = F.concat(lit(" @["), _whole(e, "bbox.x"), lit(","), _whole(e, "bbox.y"), lit("]"))
    sheet = _join(lit("sheet "), _or_end(e, "drawingNo", "sheetId"), titled, _page(e), F.concat(lit(" of "), _text(e, "sourceDocFilename")), box, F.concat(lit(' "'), F.substring(_text(e, "extractedValue"), 1, 60), lit('"')))
    rule = _join(lit("mep-rule:"), _or_end(e, "name", "ruleId"), F.concat(lit(" · factor: "), F.substring(_text(e, "factorSource"), 1, 80)), F.concat(lit(" · rate: "), F.substring(_text(e, "rateSource"), 1, 80)))
    return (
        F.when(kind == "sheet", sheet)
        .when(kind == "takeoffItem", _join(lit("takeoff "), _or_end(e, "tag", "takeoffItemId"), lit(" ("), F.coalesce(F.try_variant_get(e, "$.category", "string"), lit("undefined")), lit(")")))
        .when(kind == "document", _join(lit("doc "), F.try_variant_get(e, "$.filename", "string"), _page(e)))
        .when(kind == "rateLibrary", _join(lit("rate-lib:"), F.try_variant_get(e, "$.scope", "string"), lit(":"), F.try_variant_get(e, "$.code", "string")))
        .when(kind == "assembly", _join(lit("assembly:"), _or_end(e, "name", "assemblyId"), F.concat(lit(" ("), _text(e, "brandName"), lit(")"))))
        .when(kind == "user", _join(lit("user:"), F.right(F.try_variant_get(e, "$.userId", "string"), lit(6)), lit(" at "), F.substring(F.try_variant_get(e, "$.at", "string"), 1, 16)))
        .when(kind == "mepRule", rule)
        .when(kind == "import", _join(lit("import:"), F.try_variant_get(e, "$.importType", "string"), lit(" from "), F.try_variant_get(e, "$.sourceLabel", "string")))
        .when(kind == "legacy", _join(lit("legacy: "), F.substring(F.try_variant_get(e, "$.note", "string"), 1, 60)))
    )


def summary(provenance: Column) -> Column:
    """All evidence of a valid payload (VARIANT) but the item's own, or the first piece if there is no other."""
    listed = F.try_variant_get(provenance, "$.evidence", "array<variant>")
    others = F.filter(listed, lambda e: F.try_variant_get(e, "$.kind", "string") != "takeoffItem")
    return F.when(F.size(others) == 0, describe(F.get(listed, F.lit(0)))).otherwise(F.array_join(F.transform(others, describe), " · "))


def detail(p: Column) -> Column:
    """How a line was derived, from the parsed payload: its formula, its rule or its reasoning."""
    kind, formula, reasoning = p["derivationType"], p["formula"], p["reasoning"]
    rule = F.concat(F.coalesce(reasoning, F.lit("")), F.coalesce(F.concat(F.lit("\n  "), F.when(p["ruleRef"] != "", p["ruleRef"])), F.lit("")))
    return (
        F.when(kind == "formula", F.coalesce(formula, F.lit("(formula not recorded)"))).when(kind == "rule", rule)
        .when(kind == "ai_reasoning", F.coalesce(reasoning, F.lit("(reasoning not recorded)"))).otherwise(F.coalesce(reasoning, formula, F.lit("")))
    )
