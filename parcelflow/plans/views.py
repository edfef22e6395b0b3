"""Datasets of the charts: the data contract without the drawing. One frame with key columns, never a loop over keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parcelflow import schema
from parcelflow.functions import scalars as S
from parcelflow.functions import windows as W
from parcelflow.operators import filters
from parcelflow.plans.market import AreaPrices


def _ordered_areas(df: DataFrame, column: str, areas) -> DataFrame:
    """Add area_order, the place in a fixed list; areas not in it are dropped."""
    place = df.sparkSession.createDataFrame([(a, i) for i, a in enumerate(dict.fromkeys(areas))], f"`{column}` string, area_order int")
    return df.join(F.broadcast(place), column)  # as long as the caller's list


def price_lines(daily: DataFrame, areas=schema.AREAS) -> DataFrame:
    return _ordered_areas(daily, "neighborhood", areas).select("area_order", "neighborhood", "bedroom_type", "date", "avg_price_aed").orderBy("area_order", "bedroom_type", "date")


def latest_bars(daily: DataFrame, bedrooms: list[str] | None = None) -> DataFrame:
    """At the latest date: a row per area by falling mean price, a column per bedroom type, missing ones null."""
    latest = filters.at_latest(daily)
    order = F.avg("avg_price_aed").alias("mean_price")
    means = latest.groupBy("neighborhood").agg(order)
    wide = latest.groupBy("neighborhood").pivot("bedroom_type", bedrooms).agg(F.first("avg_price_aed"))
    return means.join(wide, "neighborhood").orderBy(F.desc("mean_price"), "neighborhood").drop("mean_price")


def price_scatter(daily: DataFrame) -> DataFrame:
    return daily.select("date", "bedroom_type", "neighborhood", "avg_price_aed", "transaction_count").orderBy("bedroom_type", "date", "neighborhood")


def daily_volume(days: DataFrame) -> DataFrame:
    return days.select("date", "transaction_count").orderBy("date")


def daily_trend(days: DataFrame, rows: int = 7) -> DataFrame:
    """Daily median and mean with their rolling means; the window sees one row per day."""
    order = Window.orderBy("date")
    means = {f"{c}_7d": W.rolling_mean(F.col(f"{c}_price_aed"), order, rows) for c in ("median", "avg")}
    return days.withColumns(means).select("date", "median_price_aed", "avg_price_aed", "median_7d", "avg_7d").orderBy("date")


def weekly_bars(weeks: DataFrame) -> DataFrame:
    return weeks.select("week", "median_pct_chg", S.direction(F.col("median_pct_chg")).alias("direction")).orderBy("week")


def area_bars(areas: DataFrame) -> DataFrame:
    return areas.select("area", "pct_change", S.direction(F.col("pct_change")).alias("direction")).orderBy("pct_change", "area")


def tier_lines(days: DataFrame, tiers: DataFrame | None = None) -> DataFrame:
    tiers = schema.tier_dimension(days.sparkSession) if tiers is None else tiers
    order = tiers.select("tier", "tier_order").distinct()
    return days.join(F.broadcast(order), "tier").select("tier_order", "tier", "date", "median_price", "median_7d").orderBy("tier_order", "date")


def area_price_lines(prices: AreaPrices, areas=schema.AREAS) -> AreaPrices:
    return AreaPrices(*(_ordered_areas(p, "area", areas).orderBy("area_order", "date") for p in prices))
