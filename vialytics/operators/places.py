"""Boxes that share space: rows of two tables meet by cells, so that a crowd is not joined with itself."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import Box

#: The side of a cell in pixels, and over how many cells a side of the largest box may reach before cells grow.
CELL, ACROSS = 256.0, 16


def extent(table: DataFrame, b: Box) -> tuple[float, float, int]:
    """(largest width, largest height, rows that miss a corner) of a table's boxes; one row reaches the driver. Sizes that
    are no number count as infinite."""
    most = (F.max(F.abs(b[i + 2] - b[i]).cast("double")) for i in (0, 1))
    *sizes, missing = table.agg(*most, F.count_if(F.isnull(b[0]) | F.isnull(b[1]) | F.isnull(b[2]) | F.isnull(b[3]))).first()
    return *(0.0 if x is None else math.inf if math.isnan(x) else x for x in sizes), missing


def cell_side(*sizes: float) -> float:
    """The side of cells for boxes as large as these; infinite ones lie in one cell."""
    return max(CELL, max(sizes) / ACROSS)


def in_cells(df: DataFrame, b: Box, side: float) -> DataFrame:
    """df with a row for each cell (cell_x, cell_y) that its box touches."""
    at = lambda i: F.sequence(F.floor(F.least(b[i], b[i + 2]) / side), F.floor(F.greatest(b[i], b[i + 2]) / side))
    return df.withColumn("cell_x", F.explode(at(0))).withColumn("cell_y", F.explode(at(1)))


def meet_here(a: Box, b: Box, side: float) -> Column:
    """Whether two boxes that touch one cell have the first corner of their common part there: true once for boxes that meet."""
    corner = lambda i: F.floor(F.greatest(F.least(a[i], a[i + 2]), F.least(b[i], b[i + 2])) / side)
    return (corner(0) == F.col("cell_x")) & (corner(1) == F.col("cell_y"))
