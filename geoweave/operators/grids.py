"""Grids of voxels: their layout, cells and index arithmetic."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Grid:
    """Origin, spacing and numbers of cells."""

    ox: float
    oy: float
    oz: float
    h: float
    nx: int
    ny: int
    nz: int

    @staticmethod
    def around(low, high, h: float, padding: int = 0, up: bool = True, pow2: bool = False) -> Grid:
        """The grid over a box: extents over h rounded up (or down), plus padding on both sides."""
        n = [(math.ceil if up else math.floor)((b - a) / h) + 2 * padding for a, b in zip(low, high, strict=True)]
        if pow2:
            n = [1 << max(0, (x - 1).bit_length()) for x in n]
        return Grid(*(a - padding * h for a in low), h, *n)

    def centre(self, axis: str, index: str) -> str:
        return f"(({index} + 5e-1) * {self.h!r}D + {getattr(self, 'o' + axis)!r}D)"

    def size(self, axis: str) -> int:
        return getattr(self, "n" + axis)

    def cells(self, spark: SparkSession, axes: str = "xyz") -> DataFrame:
        """(i, j, k) of all cells (i, j for axes xy)."""
        total = math.prod(self.size(a) for a in axes)
        nx, ny = self.nx, self.ny
        i, j, k = f"CAST(id % {nx} AS INT) AS i", f"CAST((id DIV {nx}) % {ny} AS INT) AS j", f"CAST(id DIV {nx * ny} AS INT) AS k"
        return spark.range(total).selectExpr(*([i, j, k][: len(axes)]))


def bounds(vertices: DataFrame) -> tuple[tuple[float, ...], tuple[float, ...]]:
    """Lower and upper corner of all vertices (one row)."""
    r = vertices.agg(*(f(a) for f in (F.min, F.max) for a in "xyz")).first()
    return tuple(r[:3]), tuple(r[3:])


def grid_of(vertices: DataFrame, num_voxels: int | None = None, resolution: float = 1.0, padding: int = 0, up: bool = True, pow2: bool = False) -> Grid:
    """With num_voxels the spacing is the longest extent over it."""
    low, high = bounds(vertices)
    h = max(b - a for a, b in zip(low, high, strict=True)) / num_voxels if num_voxels else resolution
    return Grid.around(low, high, h, padding, up, pow2)
