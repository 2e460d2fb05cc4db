"""Scalar expressions on pixels: validity, indices, scaling, affine transforms, growing spaces."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumigrid.functions.color import lab

#: Index name to its band pair; value (first - second) / max(first + second, 1e-6).
INDEX_BANDS = {"NDVI": ("nir", "red"), "NDGR": ("green", "red"), "NDBR": ("blue", "red")}


def is_finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))


def is_valid(bands: list[Column], nodata: float | None = 0.0) -> Column:
    """True where every band is finite and, unless nodata is NaN or None, differs from nodata."""
    out = F.lit(True)
    for b in bands:
        b = b.cast("double")
        out = out & is_finite(b)
        if nodata is not None and nodata == nodata:
            out = out & (b != F.lit(float(nodata)))
    return F.coalesce(out, F.lit(False))


def index(name: str) -> Column:
    a, b = (F.col(x).cast("double") for x in INDEX_BANDS[name])
    return (a - b) / F.greatest(a + b, F.lit(1e-6))


def finite_or_zero(x: Column) -> Column:
    return F.when(is_finite(x), x).otherwise(F.lit(0.0))


@dataclass(frozen=True)
class Affine:
    """x = c + (col + .5) a, y = f + (row + .5) e."""

    a: float = 1.0
    c: float = 0.0
    e: float = 1.0
    f: float = 0.0

    def to_map(self, row: Column, col: Column) -> tuple[Column, Column]:
        return F.lit(self.c) + (col + 0.5) * self.a, F.lit(self.f) + (row + 0.5) * self.e

    def to_pixel(self, x: Column, y: Column) -> tuple[Column, Column]:
        """Fractional (row, col)."""
        return (y - self.f) / self.e, (x - self.c) / self.a

    @property
    def pixel_area(self) -> float:
        return abs(self.a * self.e)


def growing_space(space: str, trio: tuple[str, str, str]) -> list[Column]:
    """Feature columns of a growing space over columns named by band role."""
    cols = [F.col(b).cast("double") for b in trio]
    if space == "raw":
        return cols
    lightness, a, b = lab(*cols)
    if space in ("lab", "lab_w"):
        return [lightness, a, b]
    if space == "ndvi_L":
        return [index("NDVI") * 100.0, lightness]
    raise ValueError(f"unknown growing space {space!r}")


def equivalent_perimeter(area: Column) -> Column:
    """Perimeter of the circle of the same area."""
    return F.sqrt(area * F.lit(3.141592653589793)) * 2.0
