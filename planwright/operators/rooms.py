"""Rooms from several readings: spatial labels, vision against text, finish codes, bulk acceptance, scores against the truth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planwright.functions.strings import FLOOR_LEGEND

#: Two areas agree within this part of the larger one; fixed value.
TOLERANCE = 0.02
#: Confidence of a room that both readings have and agree on, differ on, that only vision or only text has; fixed values.
AGREED, DIFFERING, VISION_ONLY, TEXT_ONLY = 90, 60, 70, 50


def areas_agree(a: Column, b: Column) -> Column:
    """Within 2 % of the larger one; two nulls agree, a null and a number do not."""
    near = F.abs(a - b) <= F.greatest(F.abs(a), F.abs(b)) * TOLERANCE
    return F.coalesce(near, a.isNull() & b.isNull())


def last_of(rows: DataFrame, keys: list[str], order: str, values: list[str]) -> DataFrame:
    """The values of the row that comes last for each key: later readings replace earlier ones."""
    return rows.groupBy(*keys).agg(F.max(F.struct(order, *values)).alias("last")).select(*keys, *[F.col(f"last.{x}").alias(x) for x in values])


def merge_spatial(read: DataFrame, spatial: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, room, area, finish_code, source): rows read as text with the areas of spatial labels of the same trimmed upper-case name; labels of other names are added.

    Both sides have keys, name, place and area, `read` finish_code, too. The last of several rows of one name counts.
    A label without an area takes the area away, as a reading without one.
    """
    room = F.upper(F.trim("name")).alias("room")
    a = last_of(read.select(*keys, room, "place", "area", "finish_code"), [*keys, "room"], "place", ["area", "finish_code"]).withColumn("read", F.lit(True))
    b = last_of(spatial.select(*keys, room, "place", F.col("area").alias("label_area")), [*keys, "room"], "place", ["label_area"]).withColumn("label", F.lit(True))
    both = a.join(b, [*keys, "room"], "full")
    source = F.when(F.col("label").isNull(), "text").when(F.col("read").isNull(), "label").otherwise("both")
    return both.select(*keys, "room", F.when(F.col("label"), F.col("label_area")).otherwise(F.col("area")).alias("area"), "finish_code", source.alias("source"))


def reconcile_rooms(vision: DataFrame, text: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, name, area, finish_code, basis, confidence, mismatch): one row for each name that either side has.

    Sides have keys, name, place, area, finish_code; of rows with one name the last counts. Values of vision win where
    both are there; a null name is a name.
    """
    side = lambda df, k: last_of(df, [*keys, "name"], "place", ["area", "finish_code"]).select(F.struct(*keys, "name").alias("key"), F.struct("area", "finish_code").alias(k))
    both = side(vision, "v").alias("a").join(side(text, "t").alias("b"), F.col("a.key").eqNullSafe(F.col("b.key")), "full")
    seen, read = F.col("v").isNotNull(), F.col("t").isNotNull()
    mismatch = seen & read & ~areas_agree(F.col("v.area"), F.col("t.area"))
    key = F.coalesce("a.key", "b.key")
    return both.select(
        *[key[k].alias(k) for k in [*keys, "name"]], F.coalesce("v.area", "t.area").alias("area"), F.coalesce("v.finish_code", "t.finish_code").alias("finish_code"),
        F.when(seen & read, "MEASURED").when(seen, "VISUAL").otherwise("PARAMETRIC").alias("basis"),
        F.when(mismatch, DIFFERING).when(seen & read, AGREED).when(seen, VISION_ONLY).otherwise(TEXT_ONLY).alias("confidence"), mismatch.alias("mismatch"))


def _holds(text: Column, phrase: Column) -> Column:
    """Whether the text holds the phrase between word borders."""
    return F.regexp_like(text, F.concat(F.lit(r"\b\Q"), phrase, F.lit(r"\E\b")))


def assign_finish(vision: Column, evidence: Column, snippet: Column, page_text: Column, legend: Column) -> Column:
    """struct(code, confidence) of a room, by the first rule that holds.

    Vision's own code, if the legend has it (surer if the page has it, too); a legend code named in the evidence; one named
    in the snippet; the only legend entry whose name, material or usage stands in the evidence. `legend` is an array
    of struct(code, name, material, usage); BATHROOM always counts as one of its codes, but is never searched for.
    """
    upper = lambda c: F.upper(F.coalesce(c, F.lit("")))
    codes = F.array_union(F.transform(legend, lambda i: F.upper(i["code"])), F.array(F.lit("BATHROOM")))
    own = F.trim(upper(vision))
    named = lambda text: F.get(F.filter(codes, lambda c: (c != "BATHROOM") & _holds(upper(text), c)), F.lit(0))
    tells = lambda i: F.exists(F.array(i["name"], i["material"], i["usage"]), lambda k: F.coalesce((F.length(F.trim(k)) > 3) & _holds(upper(evidence), F.upper(k)), F.lit(False)))
    hits = F.array_distinct(F.transform(F.filter(legend, tells), lambda i: F.upper(i["code"])))
    result = lambda code, sure: F.struct(code.alias("code"), sure.cast("int").alias("confidence"))
    ladder = F.when(F.array_contains(codes, own), result(own, F.when(_holds(F.coalesce(page_text, F.lit("")), own), 85).otherwise(70)))
    ladder = ladder.when(named(evidence).isNotNull(), result(named(evidence), F.lit(70))).when(named(snippet).isNotNull(), result(named(snippet), F.lit(70)))
    return ladder.when(F.size(hits) == 1, result(F.get(hits, F.lit(0)), F.lit(65))).otherwise(result(F.lit(None).cast("string"), F.lit(None)))


def remap_outcome(before: Column, after: Column) -> Column:
    """What a new assignment does to a room: unmapped, unchanged, newly, or changed, which a code that is taken away is, too."""
    return F.when(before.isNull() & after.isNull(), "unmapped").when(before.eqNullSafe(after), "unchanged").when(before.isNull(), "newly").otherwise("changed")


def acceptance(confirmed: Column, suggested: Column, only_floor: bool = True) -> Column:
    """struct(code, reason): the code that a bulk acceptance confirms, or why it skips the room. Empty codes count as none."""
    code = F.nullif(suggested, F.lit(""))
    other = F.lit(only_floor) & ~code.isin(*FLOOR_LEGEND)
    reason = F.when(confirmed != "", "already-confirmed").when(code.isNull(), "no-suggestion").when(other, F.concat(F.lit("non-floor-code:"), code))
    return F.struct(F.when(reason.isNull(), code).alias("code"), reason.alias("reason"))


def scorecard(found: DataFrame, truth: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n_truth, n_found, n_hit, n_within, n_mapped) of rooms by name against the truth: hits, areas within tolerance, finishes that agree."""
    one = lambda df, p: last_of(df, [*keys, "name"], "place", ["area", "finish_code"]).select(*keys, "name", F.col("area").alias(f"{p}_area"), F.col("finish_code").alias(f"{p}_finish"), F.lit(1).alias(p))
    both = one(truth, "t").join(one(found, "f"), [*keys, "name"], "full")
    hit = F.col("t").isNotNull() & F.col("f").isNotNull()
    return both.groupBy(*keys).agg(
        F.count("t").alias("n_truth"), F.count("f").alias("n_found"), F.count_if(hit).alias("n_hit"), F.count_if(hit & areas_agree(F.col("t_area"), F.col("f_area"))).alias("n_within"),
        F.count_if(hit & (F.col("t_finish") == F.col("f_finish"))).alias("n_mapped"))
