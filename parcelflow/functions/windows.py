"""Window and ordered-aggregate columns over rows (never ranges: missing days are not filled)."""

from __future__ import annotations

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F

from parcelflow.functions.scalars import divide


def pct_change(x: Column, window: WindowSpec) -> Column:
    """(x - previous) / previous; nulls before are skipped over and null itself counts as the value before it."""
    filled = F.last(x, ignorenulls=True).over(window.rowsBetween(-(1 << 31) + 1, 0))
    before = F.last(x, ignorenulls=True).over(window.rowsBetween(-(1 << 31) + 1, -1))
    return divide(filled - before, before)


def rolling_mean(x: Column, window: WindowSpec, rows: int, least: int | None = None) -> Column:
    """Mean of the last `rows` rows; null unless `least` of them (all by default) have a value."""
    frame = window.rowsBetween(1 - rows, 0)
    return F.when(F.count(x).over(frame) >= (least or rows), F.avg(x).over(frame))


def first_by(x: Column, key: Column) -> Column:
    """Value in the row of the least key, null keys first, null values included."""
    return F.min_by(F.struct(x.alias("x")), F.struct(key.alias("k")))["x"]


def last_by(x: Column, key: Column) -> Column:
    return F.max_by(F.struct(x.alias("x")), F.struct(key.alias("k")))["x"]
