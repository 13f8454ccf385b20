"""Colours of patches of pixels: the commonest colour, how much of a patch is filled, and whether it is hatched."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Near white, near black, and grey pixels are lines or background; bits of a channel that a bucket keeps; share of such pixels from which a fill is hatched.
WHITE_MAX, WHITE_MIN, BLACK, GREY = 240, 230, 50, 0.08
BUCKET = 8
HATCHED = 0.4


def is_line(p: Column) -> Column:
    """A pixel (r, g, b) of line work, text or background."""
    high, low = F.greatest(p["r"], p["g"], p["b"]), F.least(p["r"], p["g"], p["b"])
    return ((high > WHITE_MAX) & (low > WHITE_MIN)) | (high < BLACK) | (F.when(high == 0, F.lit(0.0)).otherwise((high - low) / high) < GREY)


def modal_colour(pixels: Column) -> Column:
    """struct(r, g, b, coverage) of an array of pixels: the mean of the fullest bucket, the first begun of equal ones; null if nothing but lines is there.

    Buckets are runs of the sorted array, so a patch is counted where it stands and no pixel becomes a row.
    """
    placed = F.transform(pixels, lambda p, k: F.struct(F.floor(p["r"] / BUCKET).alias("x"), F.floor(p["g"] / BUCKET).alias("y"), F.floor(p["b"] / BUCKET).alias("z"), k.alias("k"), *[p[c].cast("bigint").alias(c) for c in "rgb"]))
    kept = F.array_sort(F.filter(placed, lambda p: ~is_line(p)))
    zero = F.lit(0).cast("bigint")
    run = lambda n, k, x, y, z, r, g, b: F.struct(n.alias("n"), k.alias("k"), x.alias("x"), y.alias("y"), z.alias("z"), r.alias("r"), g.alias("g"), b.alias("b"))
    none = F.lit(-1).cast("bigint")
    empty = run(zero, F.lit(0), none, none, none, zero, zero, zero)
    better = lambda a, b: F.when((a["n"] > b["n"]) | ((a["n"] == b["n"]) & (a["k"] < b["k"])), a).otherwise(b)

    def step(a: Column, p: Column) -> Column:
        now = a["now"]
        same = (now["x"] == p["x"]) & (now["y"] == p["y"]) & (now["z"] == p["z"])
        grown = run(now["n"] + 1, now["k"], now["x"], now["y"], now["z"], now["r"] + p["r"], now["g"] + p["g"], now["b"] + p["b"])
        begun = run(F.lit(1).cast("bigint"), p["k"], p["x"], p["y"], p["z"], p["r"], p["g"], p["b"])
        return F.struct(F.when(same, grown).otherwise(begun).alias("now"), F.when(same, a["best"]).otherwise(better(now, a["best"])).alias("best"))

    best = F.aggregate(kept, F.struct(empty.alias("now"), empty.alias("best")), step, lambda a: better(a["now"], a["best"]))
    mean = lambda c: F.floor(best[c] / best["n"] + 0.5).cast("int").alias(c)
    return F.when(F.size(kept) > 0, F.struct(mean("r"), mean("g"), mean("b"), (F.size(kept) / F.size(pixels)).alias("coverage")))


def hatched(pixels: Column) -> Column:
    """Whether lines make up more than four tenths of a patch that is not lines alone; false for no pixels."""
    lines = F.size(F.filter(pixels, is_line))
    return F.coalesce((F.size(pixels) > 0) & (lines / F.nullif(F.size(pixels), F.lit(0)) > HATCHED) & (lines < F.size(pixels)), F.lit(False))
