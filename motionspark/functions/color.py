"""Colour of pixels as Column expressions (channels 0 to 255)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rgb_to_hsv(r: Column, g: Column, b: Column) -> Column:
    """struct(h in degrees, s, v); a grey has hue 0."""
    r, g, b = (c / F.lit(255.0) for c in (r, g, b))
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    d = top - low
    safe = F.when(d > 0, d)
    h = F.when(d == 0, F.lit(0.0)).when(top == r, F.pmod((g - b) / safe, F.lit(6.0))).when(top == g, (b - r) / safe + 2).otherwise((r - g) / safe + 4) * 60
    return F.struct(h.alias("h"), F.when(top > 0, d / F.when(top > 0, top)).otherwise(0.0).alias("s"), top.alias("v"))


def hue_distance(a: Column, b: Column) -> Column:
    d = F.pmod(F.abs(a - b), F.lit(360.0))
    return F.least(d, 360.0 - d)
