"""Numbers as shown and exported."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(x: Column, places: int = 4) -> Column:
    """Half up at ``places`` decimals, by the same arithmetic in every engine."""
    return F.floor(x * 10.0**places + 0.5) / 10.0**places


def fixed(x: Column, places: int = 2) -> Column:
    """Fixed decimals, a dash for what is not finite."""
    shown = F.format_number(x, places)
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), F.lit("—")).otherwise(F.regexp_replace(shown, ",", ""))


def signed(x: Column, places: int = 1) -> Column:
    """``fixed`` with a plus sign before positive numbers."""
    return F.when(x > 0, F.concat(F.lit("+"), fixed(x, places))).otherwise(fixed(x, places))
