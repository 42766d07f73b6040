"""Boxes as arrays ``[x0, y0, x1, y1]`` with the origin at the top left."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BAND = 0.12
MATCH = 3.0


def x0(box: Column) -> Column:
    return F.get(box, F.lit(0))


def y0(box: Column) -> Column:
    return F.get(box, F.lit(1))


def x1(box: Column) -> Column:
    return F.get(box, F.lit(2))


def y1(box: Column) -> Column:
    return F.get(box, F.lit(3))


def area(box: Column) -> Column:
    zero = F.lit(0.0)
    return F.greatest(zero, x1(box) - x0(box)) * F.greatest(zero, y1(box) - y0(box))


def overlap(a: Column, b: Column) -> Column:
    """Area that two boxes share."""
    zero = F.lit(0.0)
    width = F.least(x1(a), x1(b)) - F.greatest(x0(a), x0(b))
    height = F.least(y1(a), y1(b)) - F.greatest(y0(a), y0(b))
    return F.greatest(zero, width) * F.greatest(zero, height)


def overlap_ratio(a: Column, b: Column) -> Column:
    """Share of ``a`` inside ``b``; 0 for a box without area."""
    return F.when(area(a) > 0, overlap(a, b) / area(a)).otherwise(0.0)


def matches(a: Column, b: Column, tolerance: float = MATCH) -> Column:
    return F.forall(F.zip_with(a, b, lambda x, y: F.abs(x - y) <= tolerance), lambda ok: ok)


def x_overlaps(a: Column, b: Column) -> Column:
    return (F.least(x1(a), x1(b)) - F.greatest(x0(a), x0(b))) > 0


def adjacent(a: Column, b: Column, gap: float) -> Column:
    """Boxes no farther apart than ``gap`` in both directions."""
    dx = F.greatest(x0(a), x0(b)) - F.least(x1(a), x1(b))
    dy = F.greatest(y0(a), y0(b)) - F.least(y1(a), y1(b))
    return (dx <= gap) & (dy <= gap)


def edge(box: Column, page_height: Column) -> Column:
    """``top`` or ``bottom`` for a box wholly in the band at that edge of the page, else null."""
    return F.when(y1(box) <= BAND * page_height, "top").when(y0(box) >= (1 - BAND) * page_height, "bottom")
