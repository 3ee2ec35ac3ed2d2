"""Boxes, calibration and letter heights, and the schedules of quantities, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed


def rect_of(corners: Column) -> Column:
    """``x1, y1, x2, y2`` around corner points ``array<struct<x, y>>``."""
    xs, ys = F.transform(corners, lambda p: p["x"]), F.transform(corners, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("x1"), F.array_min(ys).alias("y1"), F.array_max(xs).alias("x2"), F.array_max(ys).alias("y2"))


def scaled(corners: Column, sx: Column, sy: Column) -> Column:
    return F.transform(corners, lambda p: F.struct((p["x"] / sx).alias("x"), (p["y"] / sy).alias("y")))


def sizes_of(corners: Column) -> Column:
    """``height, width, cx, cy`` of a quadrilateral: the longer of two opposite edges, the mean of the corners."""
    def edge(i: int, j: int) -> Column:
        a, b = corners[i], corners[j]
        return F.sqrt((a["x"] - b["x"]) * (a["x"] - b["x"]) + (a["y"] - b["y"]) * (a["y"] - b["y"]))

    def mean(axis: str) -> Column:
        return (corners[0][axis] + corners[1][axis] + corners[2][axis] + corners[3][axis]) / 4

    return F.struct(F.greatest(edge(0, 3), edge(1, 2)).alias("height"), F.greatest(edge(0, 1), edge(3, 2)).alias("width"), mean("x").alias("cx"), mean("y").alias("cy"))


def overlap(a: Column, b: Column, floor: bool = False) -> Column:
    """Intersection over union of two rects; 0 without an intersection.

    A union of zero is avoided by adding 1e-6 to it, or with ``floor`` by taking
    at least 1e-6.
    """
    def area(x1, y1, x2, y2):
        return F.greatest(x2 - x1, F.lit(0.0)) * F.greatest(y2 - y1, F.lit(0.0))

    both = area(F.greatest(a["x1"], b["x1"]), F.greatest(a["y1"], b["y1"]), F.least(a["x2"], b["x2"]), F.least(a["y2"], b["y2"]))
    union = area(a["x1"], a["y1"], a["x2"], a["y2"]) + area(b["x1"], b["y1"], b["x2"], b["y2"]) - both
    return F.when(both <= 0, 0.0).otherwise(both / (F.greatest(union, F.lit(1e-6)) if floor else union + 1e-6))


def calibrated(pixels: Column, mm: Column) -> Column:
    """Pixels per mm of a known dimension; null if either isn't positive."""
    return F.when((pixels > 0) & (mm > 0), pixels / mm)


def least_height(area_cm2: Column, quantity: Column | None = None) -> Column:
    """Least letter height in mm for a panel; small quantities have their own column."""
    small = F.coalesce(quantity <= fixed.SMALL_QUANTITY, F.lit(False)) if quantity is not None else F.lit(False)
    value = None
    for limit, normal, reduced in fixed.LETTER_HEIGHTS:
        height = F.when(small, reduced).otherwise(normal)
        value = height if limit is None and value is None else (F.when(area_cm2 <= limit, height) if value is None else value.otherwise(height) if limit is None else value.when(area_cm2 <= limit, height))
    return value


def contrast(a: Column, b: Column) -> Column:
    """Contrast ratio of two luminances, two decimals."""
    return F.round((F.greatest(a, b) + 0.05) / (F.least(a, b) + 0.05), 2)


def permitted_error(quantity: Column, category: Column) -> Column:
    """``limit, basis``: maximum permissible error of a declared quantity; 0 for unknown categories."""
    kind = F.lower(F.trim(category))

    def ladder(rows: list) -> Column:
        out = None
        for upto, factor, amount, text in rows:
            step = F.struct((quantity * factor if factor is not None else F.lit(amount)).alias("limit"), F.lit(text).alias("basis"))
            if upto is None:
                return step if out is None else out.otherwise(step)
            out = F.when(quantity <= upto, step) if out is None else out.when(quantity <= upto, step)
        return out

    result = F.when(kind.isin("weight", "volume", "weight_volume"), ladder(fixed.PERMITTED_ERRORS["mass"]))
    for name in ("length", "area", "number"):
        result = result.when(kind == name, ladder(fixed.PERMITTED_ERRORS[name]))
    return result.otherwise(F.struct(F.lit(0.0).alias("limit"), F.lit(fixed.UNKNOWN_ERROR).alias("basis")))


def standard_quantities(commodity: Column) -> Column:
    """The allowed quantities of a commodity; null if it is unknown."""
    table = F.create_map(*[x for k, v in fixed.STANDARD_QUANTITIES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    return F.element_at(table, F.lower(F.trim(commodity)))


def nearest_standard(commodity: Column, quantity: Column) -> Column:
    """The allowed quantity nearest to one, the smaller of two at equal distance."""
    return F.array_min(F.transform(standard_quantities(commodity), lambda v: F.struct(F.abs(v - quantity).alias("gap"), v.alias("value"))))["value"]


#: Trust in a calibration by its method.
CALIBRATION_TRUST = {"ruler": 0.90, "user_dimension": 0.85, "barcode_polygon": 0.75, "barcode_rect": 0.65}


def best_calibration(ruler: Column, height_px: Column, height_mm: Column, barcode_px: Column, by_polygon: Column) -> Column:
    """``pixels_per_mm, method, confidence`` of the first that is known: ruler, package height, bar code over 10 px wide; null if none is."""
    def option(value: Column, method: str | Column, trust: Column) -> Column:
        return F.when(value.isNotNull(), F.struct(value.alias("pixels_per_mm"), (F.lit(method) if isinstance(method, str) else method).alias("method"), trust.alias("confidence")))

    code = F.when(barcode_px > 10, barcode_px / fixed.BARCODE_WIDTH_MM)
    trust = F.when(by_polygon, CALIBRATION_TRUST["barcode_polygon"]).otherwise(CALIBRATION_TRUST["barcode_rect"])
    return F.coalesce(
        option(F.when(ruler > 0, ruler), "ruler", F.lit(CALIBRATION_TRUST["ruler"])),
        option(calibrated(height_px, height_mm), "user_dimension", F.lit(CALIBRATION_TRUST["user_dimension"])),
        option(code, "barcode", trust))


def panel_area_mm2(area_px: Column, pixels_per_mm: Column) -> Column:
    """A panel's area; without a calibration its pixels stand in; null for none."""
    return F.when(area_px > 0, F.when(pixels_per_mm > 0, area_px / (pixels_per_mm * pixels_per_mm)).otherwise(area_px))
