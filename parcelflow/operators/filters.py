"""Filters of transactions and of daily aggregates."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ALL, SALE, MORTGAGE, OFF_PLAN = "All", "Sale", "Mortgage", "Off-Plan"
#: Longer lists are joined as a broadcast table instead of being written into the plan.
LONG_LIST = 500


def property_type(df: DataFrame, name: str = "flat") -> DataFrame:
    return df.filter(F.lower(F.col("PROP_SB_TYPE_EN").cast("string")) == name)


def transaction_type(df: DataFrame, kind: str = ALL) -> DataFrame:
    """Sale, Mortgage or Off-Plan; any other value keeps all rows."""
    if kind in (SALE, MORTGAGE):
        return df.filter(F.lower(F.col("GROUP_EN").cast("string")) == {SALE: "sales", MORTGAGE: "mortgage"}[kind])
    if kind != OFF_PLAN:
        return df
    marks = [F.coalesce(F.lower(F.col(c).cast("string")).rlike(p), F.lit(False)) for c, p in (("IS_OFFPLAN_EN", "off"), ("PROCEDURE_EN", "development|payment plan")) if c in df.columns]
    return df.filter(marks[0] if len(marks) == 1 else marks[0] | marks[1]) if marks else df.filter(F.lit(False))


def members(df: DataFrame, column: str, values: list[str]) -> DataFrame:
    if len(values) <= LONG_LIST:
        return df.filter(F.col(column).isin(list(values)))
    listed = df.sparkSession.createDataFrame([(v,) for v in dict.fromkeys(values)], f"`{column}` string")
    return df.join(F.broadcast(listed), column, "left_semi")  # as long as the caller's list, which the driver holds


def day_range(df: DataFrame, start: dt.date, end: dt.date, column: str = "date") -> DataFrame:
    """Both ends included."""
    return df.filter(F.col(column).between(F.lit(start), F.lit(end)))


def equal_unless_all(df: DataFrame, column: str, value: str) -> DataFrame:
    return df if value == ALL else df.filter(F.col(column) == value)


def positive_area(df: DataFrame) -> DataFrame:
    return df.filter(F.col("ACTUAL_AREA") > 0)


def selected(daily: DataFrame, areas: list[str], bedroom: str, start: dt.date, end: dt.date) -> DataFrame:
    """Of daily aggregates by area and bedroom: those of some areas, a bedroom type and a range of days."""
    return equal_unless_all(day_range(members(daily, "neighborhood", areas), start, end), "bedroom_type", bedroom)


def at_latest(df: DataFrame, column: str = "date") -> DataFrame:
    """Rows of the greatest date; the maximum is one row, so its broadcast is bounded."""
    latest = df.agg(F.max(column).alias("__latest"))
    return df.join(F.broadcast(latest), F.col(column) == F.col("__latest")).drop("__latest")


def clamp(start: dt.date, end: dt.date, first: dt.date, last: dt.date) -> tuple[dt.date, dt.date]:
    """A requested range inside the loaded one; the whole loaded range if nothing is left."""
    inside = max(start, first), min(end, last)
    return inside if inside[0] <= inside[1] else (first, last)
