"""What goes to and comes from reading pictures of sheets: crop windows around labels, and answers put into bounds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Points and millimetres of an inch, the least side and margin of a crop in pixels, the margin in millimetres of the room, and the most confidence an answer has.
POINTS, MM = 72, 25.4
KITCHEN_PX, BEDROOM_PX, MARGIN_PX, MARGIN_MM = 1200, 1500, 300, 1500
KITCHEN_CAP, WARDROBE_CAP = 60, 55
LAYOUTS = ["I", "L", "U", "OPEN-ISLAND"]
HATCHINGS = ["parallel-line", "block", "annotation-only", "none", "ambiguous"]


def _round(x: Column) -> Column:
    return F.floor(x + 0.5).cast("bigint")


def crop(box: Column, scale: Column, dpi: Column, width: Column, height: Column, least: int | None = None) -> Column:
    """struct(x, y, width, height) in pixels around a label's `box` (x_min .. y_max in points) on a sheet of `width` by `height` pixels.

    The margin is 1.5 m at the sheet's scale, 300 pixels at least or without a scale; a side has 1200 pixels at least and
    is then cut at the sheet's edge. With `least`, a side that came out shorter is widened to it within the sheet.
    """
    pixels = lambda c: box[c] * dpi / POINTS
    margin = F.greatest(F.coalesce(F.when(scale != 0, MARGIN_MM / scale / MM * dpi), F.lit(0.0)), F.lit(float(MARGIN_PX)))

    def side(low: Column, high: Column, whole: Column) -> tuple[Column, Column]:
        size = F.greatest(high - low + 2 * margin, F.lit(float(KITCHEN_PX)))
        at = F.greatest((low + high) / 2 - size / 2, F.lit(0.0))
        at, size = _round(at), _round(F.when(at + size > whole, F.greatest(whole - at, F.lit(0.0))).otherwise(size))
        if least is None:
            return at, size
        wide = F.least(whole, F.lit(float(least)))
        moved = F.greatest(F.lit(0.0), F.least(whole - wide, at + size / 2 - wide / 2))
        return F.when(size < least, _round(moved)).otherwise(at), F.when(size < least, _round(wide)).otherwise(size)

    x, w = side(pixels("x_min"), pixels("x_max"), width)
    y, h = side(pixels("y_min"), pixels("y_max"), height)
    return F.struct(x.alias("x"), y.alias("y"), w.alias("width"), h.alias("height"))


def _finite(x: Column) -> Column:
    return F.when(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), x)


def length(x: Column) -> Column:
    """A length read: not below 0, and 0 for what is no number."""
    return F.greatest(F.coalesce(_finite(x), F.lit(0.0)), F.lit(0.0))


def confidence(x: Column, cap: int, usual: int) -> Column:
    """A whole confidence from 0 to `cap`; `usual` for what is no number."""
    return F.greatest(F.lit(0), F.least(F.lit(cap), _round(F.coalesce(_finite(x), F.lit(float(usual)))).cast("int")))


def layout(x: Column) -> Column:
    return word(x, LAYOUTS, "OTHER")


def word(x: Column, known: list[str], other: str) -> Column:
    return F.when(x.isin(*known), x).otherwise(other)
