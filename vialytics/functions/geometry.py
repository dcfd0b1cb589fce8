"""Boxes as column expressions. A box is a tuple of four columns (x1, y1, x2, y2)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Box = tuple[Column, Column, Column, Column]


def box(prefix: str = "", alias: str = "") -> Box:
    """The columns <prefix>x1 ... <prefix>y2, of a table alias if one is given."""
    return tuple(F.col(f"{alias}.{prefix}{c}" if alias else f"{prefix}{c}") for c in ("x1", "y1", "x2", "y2"))


def clip(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def width(b: Box) -> Column:
    return b[2] - b[0]


def height(b: Box) -> Column:
    return b[3] - b[1]


def area(b: Box) -> Column:
    return F.greatest(F.lit(0.0), width(b)) * F.greatest(F.lit(0.0), height(b))


def intersection(a: Box, b: Box) -> Column:
    w = F.least(a[2], b[2]) - F.greatest(a[0], b[0])
    h = F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    return F.greatest(F.lit(0.0), w) * F.greatest(F.lit(0.0), h)


def iou(a: Box, b: Box) -> Column:
    """Intersection over union; 0 where the union is empty."""
    both = intersection(a, b)
    union = area(a) + area(b) - both
    return F.when(union > 0, both / union).otherwise(F.lit(0.0))


def center(b: Box) -> tuple[Column, Column]:
    return (b[0] + b[2]) / 2, (b[1] + b[3]) / 2


def distance(p: tuple[Column, Column], q: tuple[Column, Column]) -> Column:
    return F.hypot(p[0] - q[0], p[1] - q[1])


def diagonal(b: Box) -> Column:
    return F.hypot(width(b), height(b))


def padded(b: Box, frame_width: Column, frame_height: Column, ratio: float = 0.08, least: float = 8.0) -> Box:
    """The box grown by a share of its size (at least some pixels), rounded outwards and kept inside the frame."""
    px = F.greatest(F.greatest(F.lit(0.0), width(b)) * ratio, F.lit(least))
    py = F.greatest(F.greatest(F.lit(0.0), height(b)) * ratio, F.lit(least))
    inside = lambda v, most: F.greatest(F.lit(0), F.least(most.cast("long"), v))
    return (
        inside(F.floor(b[0] - px), frame_width),
        inside(F.floor(b[1] - py), frame_height),
        inside(F.ceil(b[2] + px), frame_width),
        inside(F.ceil(b[3] + py), frame_height),
    )


def centeredness(b: Box, frame_width: Column, frame_height: Column) -> Column:
    """1 at the frame's centre, 0 in its corners."""
    most = F.hypot(frame_width / 2, frame_height / 2)
    off = distance(center(b), (frame_width / 2, frame_height / 2))
    return F.when(most <= 0, F.lit(1.0)).otherwise(clip(1 - off / most))


def edge_visibility(b: Box, frame_width: Column, frame_height: Column) -> Column:
    """The smallest distance to an edge of the frame, in box sizes, between 0 and 1."""
    w, h = F.greatest(F.lit(1.0), width(b)), F.greatest(F.lit(1.0), height(b))
    return clip(F.least(b[0] / w, (frame_width - b[2]) / w, b[1] / h, (frame_height - b[3]) / h))
