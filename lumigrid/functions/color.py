"""Colour transforms as column expressions: 8-bit sRGB (D65) to CIELAB and CIELCh."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# sRGB to XYZ matrix and the D65 white point.
XYZ = ((0.4124564, 0.3575761, 0.1804375), (0.2126729, 0.7151522, 0.0721750), (0.0193339, 0.1191920, 0.9503041))
WHITE = (0.95047, 1.0, 1.08883)


def whole(band: Column) -> Column:
    """A band as an 8-bit integer value: clipped to 0..255 and cut to whole numbers."""
    return F.floor(F.least(F.greatest(band, F.lit(0.0)), F.lit(255.0))).cast("double")


def _linear(band: Column) -> Column:
    v = band / F.lit(255.0)
    return F.when(v <= 0.04045, v / 12.92).otherwise(F.pow((v + 0.055) / 1.055, F.lit(2.4)))


def _curve(t: Column) -> Column:
    return F.when(t > 216.0 / 24389.0, F.pow(t, F.lit(1.0 / 3.0))).otherwise((t * (24389.0 / 27.0) + 16.0) / 116.0)


def lab(red: Column, green: Column, blue: Column) -> tuple[Column, Column, Column]:
    """(L, a, b) of a trio of 8-bit bands."""
    parts = [_linear(whole(b)) for b in (red, green, blue)]
    fx, fy, fz = (_curve(sum((p * w for p, w in zip(parts[1:], row[1:], strict=True)), parts[0] * row[0]) / n) for row, n in zip(XYZ, WHITE, strict=True))
    return fy * 116.0 - 16.0, (fx - fy) * 500.0, (fy - fz) * 200.0


def lch(red: Column, green: Column, blue: Column) -> tuple[Column, Column, Column]:
    """(L, C, hue in degrees from 0 to 360)."""
    lightness, a, b = lab(red, green, blue)
    hue = F.degrees(F.atan2(b, a))
    return lightness, F.sqrt(a * a + b * b), F.when(hue < 0, hue + 360.0).otherwise(hue)
