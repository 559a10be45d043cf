"""Plane geometry over columns: points, segments and boxes of a drawing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def turn(ax, ay, bx, by, cx, cy) -> Column:
    """Twice the signed area of the triangle a, b, c."""
    return (bx - ax) * (cy - ay) - (by - ay) * (cx - ax)


def segments_cross(ax, ay, bx, by, cx, cy, dx, dy) -> Column:
    """Strictly: touching ends do not count."""
    return (turn(ax, ay, bx, by, cx, cy) * turn(ax, ay, bx, by, dx, dy) < 0) & (turn(cx, cy, dx, dy, ax, ay) * turn(cx, cy, dx, dy, bx, by) < 0)


def point_in_box(px, py, x, y, w, h) -> Column:
    return px.between(x, x + w) & py.between(y, y + h)


def boxes_overlap(x1, y1, w1, h1, x2, y2, w2, h2) -> Column:
    """Strictly: shared edges do not count."""
    return (x1 < x2 + w2) & (x2 < x1 + w1) & (y1 < y2 + h2) & (y2 < y1 + h1)


def box_contains(x1, y1, w1, h1, x2, y2, w2, h2) -> Column:
    return (x1 <= x2) & (y1 <= y2) & (x1 + w1 >= x2 + w2) & (y1 + h1 >= y2 + h2)


def segment_hits_box(ax, ay, bx, by, x, y, w, h) -> Column:
    """The middle lies inside, or an edge is crossed."""
    edges = [(x, y, x + w, y), (x + w, y, x + w, y + h), (x, y + h, x + w, y + h), (x, y, x, y + h)]
    hit = point_in_box((ax + bx) / 2, (ay + by) / 2, x, y, w, h)
    for e in edges:
        hit = hit | segments_cross(ax, ay, bx, by, *e)
    return hit


def text_size(text: Column, font: Column | float = 20.0) -> Column:
    """Estimated width and height of text in a drawing."""
    font = font if isinstance(font, Column) else F.lit(font)
    lines = F.split(F.coalesce(text, F.lit("")), "\n")
    longest = F.aggregate(lines, F.lit(0), lambda m, s: F.greatest(m, F.length(s)))
    return F.struct((longest * font * 0.6).alias("width"), (F.size(lines) * font * 1.25).alias("height"))
