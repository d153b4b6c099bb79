"""Rectangles: normal form, predicates, coverage, rotation, matrices."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def overlaps(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Whether two boxes (left, bottom, right, top) share an area: touching edges don't."""
    return (a[0] < b[2]) & (a[2] > b[0]) & (a[1] < b[3]) & (a[3] > b[1])


def holds(box: tuple[Column, ...], inner: tuple[Column, ...]) -> Column:
    """Whether a box holds another, edges included."""
    return (inner[0] >= box[0]) & (inner[1] >= box[1]) & (inner[2] <= box[2]) & (inner[3] <= box[3])


def has_point(box: tuple[Column, ...], x: Column, y: Column) -> Column:
    return x.between(box[0], box[2]) & y.between(box[1], box[3])


def covered(box: tuple[Column, ...], by: tuple[Column, ...]) -> Column:
    """The share of a box that another one covers."""
    w = F.greatest(F.lit(0), F.least(box[2], by[2]) - F.greatest(box[0], by[0]))
    h = F.greatest(F.lit(0), F.least(box[3], by[3]) - F.greatest(box[1], by[1]))
    return w * h / F.greatest(F.lit(1e-6), (box[2] - box[0]) * (box[3] - box[1]))


def normalised(left: Column, bottom: Column, right: Column, top: Column) -> tuple[Column, ...]:
    return F.least(left, right), F.least(bottom, top), F.greatest(left, right), F.greatest(bottom, top)


def rotated(box: tuple[Column, ...], turn: Column, width: Column, height: Column) -> tuple[Column, ...]:
    """A box as seen on a page turned by 0, 90, 180 or 270 degrees, in the page's own coordinates (its size unturned)."""
    left, bottom, right, top = box

    def pick(*by_turn: Column) -> Column:
        return F.when(turn == 90, by_turn[1]).when(turn == 180, by_turn[2]).when(turn == 270, by_turn[3]).otherwise(by_turn[0])

    return normalised(pick(left, width - top, width - right, bottom), pick(bottom, left, height - top, height - right),
        pick(right, width - bottom, width - left, top), pick(top, right, height - bottom, height - left))


def transformed(matrix: tuple[float, ...], x: Column, y: Column) -> tuple[Column, Column]:
    """A point under a matrix (a, b, c, d, e, f)."""
    a, b, c, d, e, f = matrix
    return x * a + y * c + e, x * b + y * d + f


def multiplied(a: tuple[Column, ...], b: tuple[Column, ...]) -> tuple[Column, ...]:
    """The matrix (a to f) that applies ``a`` first and then ``b``."""
    return (
        a[0] * b[0] + a[1] * b[2], a[0] * b[1] + a[1] * b[3], a[2] * b[0] + a[3] * b[2], a[2] * b[1] + a[3] * b[3],
        a[4] * b[0] + a[5] * b[2] + b[4], a[4] * b[1] + a[5] * b[3] + b[5],
    )


def unit_box(m: tuple[Column, ...]) -> tuple[Column, ...]:
    """The box around the unit square under a matrix."""
    a, b, c, d, e, f = m
    xs, ys = (e, a + e, c + e, a + c + e), (f, b + f, d + f, b + d + f)
    return F.least(*xs), F.least(*ys), F.greatest(*xs), F.greatest(*ys)


#: Points in an inch.
POINTS = 72.0


def to_pixels(x: Column, y: Column, height: Column, dpi: Column) -> tuple[Column, Column]:
    """A point of a page, whose origin is below, as pixels from above."""
    return x * dpi / POINTS, (height - y) * dpi / POINTS


def from_pixels(px: Column, py: Column, height: Column, dpi: Column) -> tuple[Column, Column]:
    return px * POINTS / dpi, height - py * POINTS / dpi


def to_visual(x: Column, y: Column, width: Column, height: Column, turn: Column) -> tuple[Column, Column]:
    """A point as it is seen on a page that is turned clockwise, from the lower left of what is seen."""
    vx = F.when(turn == 90, y).when(turn == 180, width - x).when(turn == 270, height - y).otherwise(x)
    vy = F.when(turn == 90, width - x).when(turn == 180, height - y).when(turn == 270, x).otherwise(y)
    return vx, vy
