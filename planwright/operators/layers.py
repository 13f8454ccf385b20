"""Which layers of a drawing play which role: scored by name, checked by content, the best few of each role."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Names that layers of a role have by the standard, what else their names hold (the earlier the better), and what they must contain.
STANDARD = {
    "roomBounds": ["A-AREA-ROOM", "A-AREA", "A-WALL", "ROOMS", "ROOM"],
    "roomLabels": ["A-ANNO-ROOM", "A-ANNO-NOTE", "A-AREA-IDEN", "ROOM-NAMES", "TEXT-ROOMS"],
    "doors": ["A-DOOR", "A-DOOR-SYMB", "DOORS"],
    "windows": ["A-GLAZ", "A-WINDOW", "WINDOWS"],
    "walls": ["A-WALL", "WALLS"],
}
TOKENS = {
    "roomBounds": ["AREA-ROOM", "ROOM", "WALL"],
    "roomLabels": ["AREA-IDEN", "FLOR-IDEN", "ROOM-IDEN", "ANNO-ROOM", "ROOM-NAMES", "TEXT-ROOM", "ANNO-NOTE", "IDEN"],
    "doors": ["DOOR"],
    "windows": ["GLAZ", "WINDOW"],
    "walls": ["WALL"],
}
NEEDS = {"roomBounds": "closed_polylines", "roomLabels": "texts", "doors": "inserts", "windows": "inserts"}


def score(layer: Column, role: str) -> Column:
    """100 for a standard name, 90 less 10 for each better token for a name that holds one, else 0."""
    upper = F.upper(layer)
    out = F.when(upper.isin(*STANDARD[role]), 100)
    for k, token in enumerate(TOKENS[role]):
        out = out.when(upper.contains(token), 90 - 10 * k)
    return out.otherwise(0)


def suggestions(layers: DataFrame, k: int = 5) -> DataFrame:
    """(drawing_id, role, place, layer, score): at most `k` layers of each drawing for each role, the best first.

    `layers` has drawing_id, layer, entities, closed_polylines, texts and inserts. Order is by score, entities and name,
    so ties have one result; layers without entities or without what the role needs are left out. The limit on the
    place is applied in each task before the shuffle, so no task gets more than `k` rows a role and task.
    """
    number = lambda c: F.coalesce(F.col(c), F.lit(0))
    roles = [F.when(number(NEEDS[r]) > 0 if r in NEEDS else F.lit(True), F.struct(F.lit(r).alias("role"), score(F.col("layer"), r).alias("score"))) for r in STANDARD]
    scored = layers.where(number("entities") > 0).select("drawing_id", "layer", "entities", F.explode(F.array_compact(F.array(*roles))).alias("s")).where("s.score > 0").select("drawing_id", "s.role", "layer", "s.score", "entities")
    best = Window.partitionBy("drawing_id", "role").orderBy(F.desc("score"), F.desc("entities"), F.col("layer"))
    return scored.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k).select("drawing_id", "role", "place", "layer", "score")
