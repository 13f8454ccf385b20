"""Nearest-label joins on a plan sheet."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planwright.session import discard, materialize


def met_within(points: DataFrame, labels: DataFrame, radius: float, beyond: str | None = None) -> DataFrame:
    """(page, point_id, label_id, d2): each point with the labels of its page within `radius`; `beyond` is a column of the points, and only larger squares count."""
    cell = lambda c: F.floor(F.col(c) / radius)
    spread = labels.select("page", F.col("point_id").alias("label_id"), F.col("x").alias("lx"), F.col("y").alias("ly"), cell("x").alias("cx"), cell("y").alias("cy"))
    for c in ("cx", "cy"):
        spread = spread.withColumn(c, F.explode(F.sequence(F.col(c) - 1, F.col(c) + 1)))
    placed = points.select("page", "point_id", "x", "y", *([beyond] if beyond else []), cell("x").alias("cx"), cell("y").alias("cy"))
    square = (F.col("x") - F.col("lx")) * (F.col("x") - F.col("lx")) + (F.col("y") - F.col("ly")) * (F.col("y") - F.col("ly"))
    return placed.join(spread, ["page", "cx", "cy"]).withColumn("d2", square).where((F.col("d2") <= radius * radius) & (F.col("d2") > F.col(beyond) if beyond else F.lit(True))).select("page", "point_id", "label_id", "d2")


#: Pairs of a point and a label in one cell, for each point, that the first search makes at most, and the times a radius is halved for it.
_PAIRS_A_POINT, _HALVINGS = 2, 10


def _halvings(points: DataFrame, labels: DataFrame, radius: float) -> int:
    """How often `radius` is halved until the cells of that size hold few pairs."""
    level = F.explode(F.sequence(F.lit(0), F.lit(_HALVINGS))).alias("level")
    cell = lambda c: F.floor(F.col(c) * F.pow(F.lit(2.0), "level") / radius).alias(f"c{c}")
    rows = points.select("page", "x", "y", F.lit(1).alias("n"), F.lit(0).alias("m"), level).unionByName(labels.select("page", "x", "y", F.lit(0).alias("n"), F.lit(1).alias("m"), level))
    cells = rows.groupBy("level", "page", cell("x"), cell("y")).agg(F.sum("n").alias("n"), F.sum("m").alias("m"))
    found = cells.groupBy("level").agg(F.sum(F.col("n") * F.col("m")).alias("pairs"), F.sum("n").alias("points")).collect()  # one row a level
    return min((r["level"] for r in found if r["pairs"] <= _PAIRS_A_POINT * r["points"]), default=_HALVINGS)


def one_to_one(points: DataFrame, labels: DataFrame, radius: float) -> DataFrame:
    """(page, point_id, label_id, distance): in order of their ids points take the nearest label of their page within `radius` that no earlier one has taken.

    All points ask for their best label at once, and each label keeps the smallest id that ever asked. It can only pass to a
    smaller one still, so its pairs with larger ids are dropped, and those turned away ask for their next label until nobody
    is turned away: the same choice as in order, in a number of rounds that hardly grows with the points. Pairs are
    made within a small radius first; only points without a label there search on, in rings. No page is ever held in one
    task. Ties go to the smaller label id, points without a free label give no row, and neither do those with a null page
    or place.
    """
    whole = lambda df: df.where(F.col("page").isNotNull() & F.col("x").isNotNull() & F.col("y").isNotNull()).select("page", "point_id", "x", "y")
    names = materialize(whole(labels), "labels")
    # The square of how far each point has searched.
    seeking = materialize(whole(points).withColumn("seen", F.lit(-1.0)), "points")
    halved = _halvings(seeking, names, radius)
    pairs = hold = None
    while True:
        reach = radius / 2**halved
        waiting = seeking.where(F.col("seen") < radius * radius)
        if pairs is not None:
            waiting = materialize(waiting.join(pairs.select("page", "point_id").distinct(), ["page", "point_id"], "left_anti"), "points-waiting")
            if waiting.isEmpty():
                discard(waiting, seeking, names)
                best = pairs.groupBy("page", "point_id").agg(F.min(F.struct("d2", "label_id")).alias("b"))
                return best.select("page", "point_id", "b.label_id", F.sqrt("b.d2").alias("distance"))
        ring = met_within(waiting, names, reach, "seen").select(*_PAIR)
        if pairs is not None:
            ring = ring.join(hold, ["page", "label_id"], "left").where(F.col("holder").isNull() | (F.col("point_id") < F.col("holder"))).select(*_PAIR).unionByName(pairs)
        searched = seeking if pairs is None else seeking.join(waiting.select("page", "point_id").distinct().withColumn("_w", F.lit(True)), ["page", "point_id"], "left")
        now = F.lit(True) if pairs is None else F.col("_w").isNotNull()
        old, pairs = [pairs, hold, seeking] + ([waiting] if pairs is not None else []), materialize(ring, "label-pairs")
        seeking = materialize(searched.withColumn("seen", F.when(now, F.greatest("seen", F.lit(reach * reach))).otherwise(F.col("seen"))).select("page", "point_id", "x", "y", "seen"), "points")
        discard(*[t for t in old if t is not None])
        pairs, hold = _settled(pairs)
        halved = max(halved - 1, 0)


_PAIR = ["page", "point_id", "label_id", "d2"]


def _settled(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The pairs left when no point is turned away any more, and the holder of each label asked for."""
    while True:
        best = pairs.groupBy("page", "point_id").agg(F.min(F.struct("d2", "label_id")).alias("b"))
        hold = materialize(best.groupBy("page", F.col("b.label_id").alias("label_id")).agg(F.min("point_id").alias("holder"), F.count(F.lit(1)).alias("n")), "label-holders")
        kept = pairs.join(hold.drop("n"), ["page", "label_id"], "left").where(F.col("holder").isNull() | (F.col("point_id") <= F.col("holder"))).select(*_PAIR)
        if hold.where("n > 1").isEmpty():
            return pairs, hold.drop("n")
        before, pairs = pairs, materialize(kept, "label-pairs")
        discard(before, hold)


def nearest_within(points: DataFrame, labels: DataFrame, radius: float) -> DataFrame:
    """For each point the nearest label of its page within `radius`, ties to the smaller id; null if there is none.

    Labels are entered in the nine cells around theirs, so an equi-join on page and cell finds every label in reach
    and no pair farther than two cells apart is made.
    """
    met = met_within(points, labels, radius)
    best = met.groupBy("page", "point_id").agg(F.min(F.struct("d2", "label_id")).alias("b"))
    return points.join(best, ["page", "point_id"], "left").select("page", "point_id", F.col("b.label_id").alias("label_id"), F.sqrt("b.d2").alias("distance"))
