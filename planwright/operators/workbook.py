"""A bill as a workbook: its summary with discount and VAT, and the rows of all tabs in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# What is done with lines of placeholder rates, titles, characters that no tab's name may have, and its length.
MODES = ("inline", "tab", "exclude")
DRAFT_TAB = "DRAFT MEP — not for pricing"
NO_TAB_CHARACTERS, TAB_LENGTH = r"[\\/?*\[\]:]", 31


def tab_name(name: Column) -> Column:
    """`name` as the name of a tab: forbidden characters are blanks, 31 characters at most, trimmed."""
    return F.trim(F.substring(F.regexp_replace(name, NO_TAB_CHARACTERS, " "), 1, TAB_LENGTH))


def _money(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(0)).cast("decimal(18,2)")


def _checked(lines: DataFrame, mode: str) -> DataFrame:
    if mode not in MODES:
        raise ValueError(f"mode is one of {MODES}")
    draft = F.coalesce(F.col("is_placeholder"), F.lit(False)) if mode != "inline" else F.lit(False)
    return lines.withColumns({"is_provisional": F.coalesce("is_provisional", F.lit(False)), "_draft": draft})


def section_sums(lines: DataFrame, mode: str) -> DataFrame:
    """(project_id, section, n, priced, provisional, n_draft, draft) of `lines`, one small row a section."""
    own, provisional = ~F.col("_draft"), F.col("is_provisional")
    total = lambda on, c: F.coalesce(F.sum(F.when(on, _money(c))), F.lit(0)).cast("decimal(28,2)")
    return _checked(lines, mode).groupBy("project_id", "section").agg(
        F.count_if(own).alias("n"), total(own & ~provisional, "amount").alias("priced"), total(own & provisional, "ps_amount").alias("provisional"),
        F.count_if(F.col("_draft")).alias("n_draft"), total(F.col("_draft") & ~provisional, "amount").alias("draft"))


def summary(lines: DataFrame, terms: DataFrame, mode: str = "tab") -> DataFrame:
    """(project_id, kind, section, label, priced, provisional), to be read by project, kind and section.

    `lines` has project_id, section, amount, ps_amount, is_provisional and is_placeholder; `terms` discount and vat_pct of a
    project. Discount and VAT fall on what is priced alone; their rows stand where they are above 0. Lines of placeholder
    rates count as others (inline), or are moved to a draft tab or excluded; then a row says their sum, which is in no total.
    Defined results: missing and null terms, amounts and marks count as 0 and false; a null section is one; a section of
    drafts alone has no row; a project without lines has no rows; repeated rows count each.
    """
    sums = section_sums(lines, mode)
    add = lambda c: F.sum(c).cast("double").alias(c)
    totals = sums.groupBy("project_id").agg(add("priced"), add("provisional"), F.sum("n_draft").alias("n_draft"), add("draft"))
    number = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    known = terms.groupBy(F.col("project_id").alias("_project")).agg(F.max("discount").alias("discount"), F.max("vat_pct").alias("vat_pct"))
    totals = totals.join(known, F.col("project_id").eqNullSafe(F.col("_project")), "left")
    discount, vat_pct = number("discount"), number("vat_pct")
    after = F.col("priced") - F.when(discount > 0, discount).otherwise(0.0)
    vat = F.when(vat_pct > 0, after * (vat_pct / 100)).otherwise(0.0)
    none = F.lit(None).cast("double")
    row = lambda kind, label, priced=none, provisional=none: F.struct(F.lit(kind).alias("kind"), (label if isinstance(label, Column) else F.lit(label)).alias("label"), priced.alias("priced"), provisional.alias("provisional"))
    moved = "moved to the draft tab" if mode == "tab" else "excluded"
    rows = F.array_compact(F.array(
        F.when(F.col("n_draft") > 0, row(0, F.concat(F.lit("Placeholder rates: "), F.col("n_draft").cast("string"), F.lit(f" line(s) {moved}")), F.col("draft"))),
        row(2, "Measured / priced subtotal", F.col("priced")),
        F.when(discount > 0, row(3, "Discount (priced only)", -discount)),
        F.when(vat_pct > 0, row(4, F.concat(F.lit("VAT on priced ("), F.format_string("%.2f", vat_pct), F.lit("%)")), vat)),
        F.when(vat_pct > 0, row(5, "Priced subtotal (after discount + VAT)", after + vat)),
        row(6, "Provisional sums", provisional=F.col("provisional")),
        row(7, "GRAND TOTAL (priced + P/S)", provisional=after + vat + F.col("provisional")),
    ))
    sections = sums.where("n > 0").select("project_id", F.lit(1).alias("kind"), "section", F.col("section").alias("label"), F.col("priced").cast("double").alias("priced"), F.col("provisional").cast("double").alias("provisional"))
    fixed = totals.select("project_id", F.inline(rows)).select("project_id", "kind", F.lit(None).cast("string").alias("section"), "label", "priced", "provisional")
    return sections.unionByName(fixed)


def tab_rows(lines: DataFrame, mode: str = "tab") -> DataFrame:
    """(project_id, tab_no, section, kind, item_no, tab, line): the rows of the section tabs and of the draft tab.

    `lines` also has item_no, description, unit, qty and rate. Kinds are 0 for a line, 1 to 3 for a section's priced,
    provisional (if above 0) and whole sum, 4 for the sum of a section in the draft tab, 5 for the whole draft. Cells are
    divided by tabs; null cells are empty, provisional lines show what is set aside for them. To be read by project,
    tab_no, section, kind and item_no: a total order where item numbers do not repeat.
    """
    each = _checked(lines, mode)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    money = F.when(F.col("is_provisional"), _money("ps_amount")).otherwise(_money("amount"))
    cells = F.concat_ws("\t", text("item_no"), F.translate(text("description"), "\t\n\r", "   "), text("qty"), text("unit"), F.when(F.col("is_provisional"), "P/S").otherwise(text("rate")), money.cast("string"))
    own = each.select("project_id", "section", F.col("item_no").cast("bigint").alias("item_no"), "_draft", "is_provisional", money.alias("_money"), cells.alias("_cells"))
    # Sums stand beside the lines, and the first line of a section or project brings their rows: lines are neither moved
    # nor made once more for them. Both windows need one order of the lines.
    of_section, of_project = Window.partitionBy("project_id", "section").orderBy("item_no"), Window.partitionBy("project_id").orderBy("section", "item_no")
    whole = lambda w: w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    draft, provisional = F.col("_draft"), F.col("is_provisional")
    total = lambda on, w: F.coalesce(F.sum(F.when(on, F.col("_money"))).over(whole(w)), F.lit(0)).cast("decimal(28,2)")
    count = lambda on, w: F.count_if(on).over(whole(w))
    own = own.withColumns({
        "_first": F.row_number().over(of_section) == 1, "n": count(~draft, of_section), "priced": total(~draft & ~provisional, of_section), "provisional": total(~draft & provisional, of_section),
        "n_draft": count(draft, of_section), "draft": total(draft & ~provisional, of_section)})
    if mode == "tab":
        own = own.withColumns({"_first_of_all": F.row_number().over(of_project) == 1, "n_drafts": count(draft, of_project), "drafts": total(draft & ~provisional, of_project)})
    name, mine = F.coalesce("section", F.lit("")), tab_name(F.coalesce("section", F.lit("")))
    fields = lambda tab_no, section, kind, item_no, tab, line: F.struct(tab_no.alias("tab_no"), section.alias("section"), F.lit(kind).alias("kind"), item_no.alias("item_no"), tab.alias("tab"), line.alias("line"))
    none = F.lit(None).cast("bigint")
    row = lambda tab_no, kind, tab, label, value: fields(F.lit(tab_no), F.col("section"), kind, none, tab, F.concat(label, F.lit("\t"), value.cast("decimal(28,2)").cast("string")))
    label = lambda before, after: F.concat(F.lit(before), name, F.lit(after))
    some = F.col("_first") & (F.col("n") > 0)
    rows = [
        F.when(~draft if mode == "exclude" else F.lit(True), fields(F.when(draft, 2).otherwise(1), F.col("section"), 0, F.col("item_no"), F.when(draft, F.lit(DRAFT_TAB)).otherwise(mine), F.col("_cells"))),
        F.when(some, row(1, 1, mine, label("Subtotal — ", " priced"), F.col("priced"))),
        F.when(some & (F.col("provisional") > 0), row(1, 2, mine, label("Subtotal — ", " P/S"), F.col("provisional"))),
        F.when(some, row(1, 3, mine, label("Section ", " total (priced + P/S)"), F.col("priced") + F.col("provisional"))),
    ]
    if mode == "tab":
        rows.append(F.when(F.col("_first") & (F.col("n_draft") > 0), row(2, 4, F.lit(DRAFT_TAB), label("Subtotal — ", " DRAFT (not for pricing)"), F.col("draft"))))
        # The last row of the draft tab: after all sections.
        last = F.concat(F.lit("DRAFT MEP total (would have been added if confirmed)\t"), F.col("drafts").cast("string"))
        rows.append(F.when(F.col("_first_of_all") & (F.col("n_drafts") > 0), fields(F.lit(3), F.lit(None).cast("string"), 5, none, F.lit(DRAFT_TAB), last)))
    return own.select("project_id", F.inline(F.array_compact(F.array(*rows)))).select("project_id", "tab_no", "section", "kind", "item_no", "tab", "line")
