"""Box arithmetic as column expressions.

Every function takes and returns ``Column`` objects, so the work stays inside
whole-stage code generation and filters built from it can be combined freely.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


class Box(NamedTuple):
    """Corners: left, top, right, bottom."""

    x0: Column
    y0: Column
    x1: Column
    y1: Column

    @property
    def width(self) -> Column:
        return self.x1 - self.x0

    @property
    def height(self) -> Column:
        return self.y1 - self.y0


class Rect(NamedTuple):
    """Origin and size."""

    x: Column
    y: Column
    width: Column
    height: Column


def box(prefix: str = "") -> Box:
    return Box(*(F.col(prefix + name) for name in ("x0", "y0", "x1", "y1")))


def to_corners(rect: Rect, crop_x: Column, crop_y: Column) -> Box:
    """Origin and size to corners, seen from the crop's origin."""
    left, top = rect.x - crop_x, rect.y - crop_y
    return Box(left, top, rect.x + rect.width - crop_x, rect.y + rect.height - crop_y)


def overlap_area(a: Box, b: Box) -> Column:
    zero = F.lit(0.0)
    across = F.greatest(zero, F.least(a.x1, b.x1) - F.greatest(a.x0, b.x0))
    down = F.greatest(zero, F.least(a.y1, b.y1) - F.greatest(a.y0, b.y0))
    return across * down


def iou(a: Box, b: Box) -> Column:
    """Overlap over union; boxes must have positive area."""
    shared = overlap_area(a, b)
    return shared / (a.width * a.height + b.width * b.height - shared)


def grid_error(pred: Box, truth: Box) -> Column:
    """Largest edge error, counted in cells of the 8x8 truth grid."""
    wide, tall = truth.width, truth.height
    return F.greatest(
        F.abs(pred.x0 - truth.x0) * 8 / wide,
        F.abs(pred.x1 - truth.x1) * 8 / wide,
        F.abs(pred.y0 - truth.y0) * 8 / tall,
        F.abs(pred.y1 - truth.y1) * 8 / tall,
    )


def is_valid(b: Box) -> Column:
    """Finite corners in the right order; null or NaN is invalid."""
    finite = F.lit(True)
    for edge in b:
        finite = finite & ~F.isnan(edge) & (F.abs(edge) != F.lit(float("inf")))
    return F.coalesce(finite & (b.x1 > b.x0) & (b.y1 > b.y0), F.lit(False))


def in_bounds(b: Box, width: Column, height: Column) -> Column:
    return (b.x0 >= 0) & (b.y0 >= 0) & (b.x1 <= width) & (b.y1 <= height)


def _clip(value: Column, upper: Column) -> Column:
    return F.least(F.greatest(value, F.lit(0.0)), upper)


def clamp_rect(rect: Rect, width: Column, height: Column) -> Rect:
    """Clip to ``[0, width] x [0, height]``; sizes never turn negative."""
    wide, tall = F.greatest(width, F.lit(0.0)), F.greatest(height, F.lit(0.0))
    left, top = _clip(rect.x, wide), _clip(rect.y, tall)
    right, bottom = _clip(rect.x + rect.width, wide), _clip(rect.y + rect.height, tall)
    zero = F.lit(0.0)
    return Rect(left, top, F.greatest(zero, right - left), F.greatest(zero, bottom - top))


def normalise(rect: Rect, width: Column, height: Column) -> Rect:
    """Display pixels to fractions of the page; a page without area gives zeros."""
    empty = (width <= 0) | (height <= 0)
    scaled = (
        F.try_divide(rect.x, width),
        F.try_divide(rect.y, height),
        F.try_divide(rect.width, width),
        F.try_divide(rect.height, height),
    )
    return Rect(*(F.when(empty, F.lit(0.0)).otherwise(part) for part in scaled))


def denormalise(rect: Rect, width: Column, height: Column) -> Rect:
    return Rect(rect.x * width, rect.y * height, rect.width * width, rect.height * height)


def round_half_up(value: Column) -> Column:
    """Half goes up for negatives too, unlike ``F.round``."""
    return F.floor(value + 0.5).cast("double")


def to_pixels(rect: Rect, width: Column, height: Column) -> Rect:
    """Fractions to whole source pixels, inside the page and never empty."""

    def axis(start: Column, size: Column, extent: Column) -> tuple[Column, Column]:
        limit = F.greatest(F.lit(1.0), round_half_up(extent))
        low = _clip(round_half_up(start * limit), limit)
        high = F.greatest(low, _clip(round_half_up((start + size) * limit), limit))
        # an empty span becomes one pixel, pulled back when it sits on the far edge
        first = F.when((high == low) & (low + 1 > limit), limit - 1).otherwise(low)
        return first, F.greatest(F.lit(1.0), high - low)

    left, wide = axis(rect.x, rect.width, width)
    top, tall = axis(rect.y, rect.height, height)
    return Rect(left, top, wide, tall)


def within_tolerance(a: Rect, b: Rect, side: Column) -> Column:
    """Every edge within 4 px or 1% of the displayed side, whichever is larger."""
    allowed = F.greatest(F.lit(4.0), side * 0.01)
    close = F.lit(True)
    for mine, other in zip(a, b):
        close = close & (F.abs(mine - other) <= allowed)
    return close


def pad_outward(rect: Rect, fraction: float, width: Column, height: Column) -> Rect:
    """Grow by a fraction of the width, snap outward to whole pixels, clip."""
    margin = rect.width * fraction
    left = F.greatest(F.lit(0.0), F.floor(rect.x - margin).cast("double"))
    top = F.greatest(F.lit(0.0), F.floor(rect.y - margin).cast("double"))
    right = F.least(width, F.ceil(rect.x + rect.width + margin).cast("double"))
    bottom = F.least(height, F.ceil(rect.y + rect.height + margin).cast("double"))
    return Rect(left, top, right - left, bottom - top)


def normalise_drag(px: Column, py: Column, qx: Column, qy: Column) -> Rect:
    return Rect(F.least(px, qx), F.least(py, qy), F.abs(qx - px), F.abs(qy - py))


def flip_y_normalise(rect: Rect, width: Column, height: Column) -> Rect:
    """Bottom-left points to top-left fractions of the page."""
    return Rect(
        rect.x / width,
        (height - rect.y - rect.height) / height,
        rect.width / width,
        rect.height / height,
    )


def visible_part(b: Box, width: Column, height: Column) -> tuple[Box, Column]:
    """The part of ``b`` on the page, and whether anything was cut away."""
    seen = Box(
        F.greatest(F.lit(0.0), b.x0),
        F.greatest(F.lit(0.0), b.y0),
        F.least(width, b.x1),
        F.least(height, b.y1),
    )
    cut = (seen.x0 != b.x0) | (seen.y0 != b.y0) | (seen.x1 != b.x1) | (seen.y1 != b.y1)
    return seen, cut


def cell_center(b: Box, row: Column, col: Column) -> tuple[Column, Column]:
    return b.x0 + (col + 0.5) * b.width / 8, b.y0 + (row + 0.5) * b.height / 8


def is_dark(row: Column, col: Column) -> Column:
    return F.pmod(row + col, F.lit(2)) == 1
