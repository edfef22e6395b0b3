"""The market queries. Every one starts from base(), takes aggregates early and windows only over aggregated rows."""

from __future__ import annotations

import datetime as dt
from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parcelflow import schema
from parcelflow.functions import scalars as S
from parcelflow.functions import windows as W
from parcelflow.operators import filters
from parcelflow.operators.distribution import describe

LEAST_TRANSACTIONS = 50


class AreaPrices(NamedTuple):
    transactions: DataFrame
    rolling: DataFrame


def base(tx: DataFrame, kind: str = filters.ALL, strict: bool = False) -> DataFrame:
    """Flats of a transaction type, with a typed date. strict: a canonical date that is none is an error, not null."""
    rows = filters.transaction_type(filters.property_type(tx), kind)
    return rows if "date" in rows.columns else rows.withColumn("date", S.day_of(F.col("INSTANCE_DATE"), strict))


def daily_area_bedroom(tx: DataFrame, kind: str = filters.ALL) -> DataFrame:
    rows = base(tx, kind).select(
        "date",
        F.col("AREA_EN").alias("neighborhood"),
        S.bedroom(F.col("ROOMS_EN")).alias("bedroom_type"),
        "TRANS_VALUE",
        "ACTUAL_AREA",
        S.divide(F.col("TRANS_VALUE"), F.col("ACTUAL_AREA")).alias("ratio"),
    )
    return rows.groupBy("date", "neighborhood", "bedroom_type").agg(
        S.round_to(F.avg("TRANS_VALUE")).alias("avg_price_aed"),
        S.round_to(F.avg("ratio"), 1).alias("price_per_sqft_aed"),
        S.round_to(F.avg("ACTUAL_AREA"), 1).alias("avg_size_sqft"),
        F.count("TRANS_VALUE").alias("transaction_count"),
    )


def daily_market(tx: DataFrame, kind: str = filters.ALL) -> DataFrame:
    days = describe(base(tx, kind), ["date"], F.col("TRANS_VALUE"), [0.5])
    return days.select("date", F.col("n").alias("transaction_count"), S.round_to(F.col("q")[0]).alias("median_price_aed"), S.round_to(F.col("mean")).alias("avg_price_aed")).orderBy("date")


def weekly_totals(tx: DataFrame, kind: str = filters.ALL) -> DataFrame:
    weeks = describe(base(tx, kind).withColumn("week", S.week_of(F.col("date"))), ["week"], F.col("TRANS_VALUE"), [0.5])
    return weeks.select("week", F.col("n").alias("txns"), S.round_to(F.col("q")[0]).alias("median"), S.round_to(F.col("mean")).alias("mean"))


def momentum(weeks: DataFrame) -> DataFrame:
    """Changes from week to week of week, txns, median, mean; the window sees one row per week."""
    order = Window.orderBy("week")
    changes = {name: S.round_to(W.pct_change(F.col(c), order) * 100, 1) for c, name in (("median", "median_pct_chg"), ("mean", "mean_pct_chg"), ("txns", "txn_pct_chg"))}
    return weeks.withColumns(changes | {"mean_median_ratio": S.round_to(S.divide(F.col("mean"), F.col("median")), 2)}).orderBy("week")


def weekly_momentum(tx: DataFrame, kind: str = filters.ALL) -> DataFrame:
    return momentum(weekly_totals(tx, kind))


def area_change(tx: DataFrame, kind: str = filters.ALL, least: int = LEAST_TRANSACTIONS) -> DataFrame:
    """First against last week's median by area, from one aggregate of the weekly one: no join."""
    weeks = base(tx, kind).groupBy(F.col("AREA_EN").alias("area"), S.week_of(F.col("date")).alias("week"))
    weeks = weeks.agg(F.count("TRANS_VALUE").alias("txns"), S.round_to(F.median("TRANS_VALUE")).alias("median"))
    areas = weeks.groupBy("area").agg(
        F.sum("txns").alias("total_txns"),
        W.first_by(F.col("median"), F.col("week")).alias("first_median"),
        W.last_by(F.col("median"), F.col("week")).alias("last_median"),
    )
    first, last = F.col("first_median"), F.col("last_median")
    change = S.round_to(S.divide(last - first, first) * 100, 1)
    # A null area would match nothing in the joins that this replaces.
    return areas.filter((F.col("total_txns") >= least) & F.col("area").isNotNull()).withColumn("pct_change", change).orderBy("pct_change", "area")


def tier_daily(tx: DataFrame, kind: str = filters.ALL, tiers: DataFrame | None = None, rows: int = 7) -> DataFrame:
    """Daily median by tier with its rolling mean; the tier table filters and looks up in one broadcast join."""
    tiers = schema.tier_dimension(tx.sparkSession) if tiers is None else tiers
    found = base(tx, kind).join(F.broadcast(tiers), F.col("AREA_EN") == F.col("tier_area"))
    days = describe(found, ["date", "tier"], F.col("TRANS_VALUE"), [0.5]).select("date", "tier", S.round_to(F.col("q")[0]).alias("median_price"), F.col("n").alias("txns"))
    mean = W.rolling_mean(F.col("median_price"), Window.partitionBy("tier").orderBy("date"), rows)
    return days.withColumn("median_7d", mean).orderBy("tier", "date")


def area_prices(tx: DataFrame, kind: str = filters.ALL, bedroom: str = filters.ALL, rows: int = 14, least: int | None = None) -> AreaPrices:
    """Price per area by transaction, and daily medians by area with their rolling mean."""
    found = filters.equal_unless_all(filters.positive_area(base(tx, kind)).withColumn("bedroom_type", S.bedroom(F.col("ROOMS_EN"))), "bedroom_type", bedroom)
    found = found.select("date", F.upper("AREA_EN").alias("area"), S.divide(F.col("TRANS_VALUE"), F.col("ACTUAL_AREA")).alias("price_per_sqft"))
    days = found.groupBy("date", "area").agg(S.round_to(F.median("price_per_sqft")).alias("daily_median_psf"))
    mean = W.rolling_mean(F.col("daily_median_psf"), Window.partitionBy("area").orderBy("date"), rows, least)
    return AreaPrices(found.orderBy("area", "date"), days.withColumn("rolling_median_psf", mean).orderBy("area", "date"))


def filtered_daily(tx: DataFrame, areas: list[str], bedroom: str, start: dt.date, end: dt.date, kind: str = filters.ALL) -> DataFrame:
    """daily_area_bedroom() of a selection; all filters are on keys and so move below the aggregate, into the scan."""
    return filters.selected(daily_area_bedroom(tx, kind), areas, bedroom, start, end)


def headline(daily: DataFrame) -> DataFrame:
    """One row: means at the latest date, and the change against day 1 of that month a year before; no row if daily is empty."""
    by_day = daily.groupBy("date").agg(F.sum("avg_price_aed").alias("p"), F.count("avg_price_aed").alias("np"), F.avg("price_per_sqft_aed").alias("avg_psf"), F.sum("transaction_count").alias("transactions"))
    by_day = by_day.withColumn("avg_price", S.divide(F.col("p"), F.nullif(F.col("np"), F.lit(0))))
    latest = filters.at_latest(by_day)
    before = by_day.select(F.col("date").alias("b_date"), F.col("avg_price").alias("b_price"))
    out = latest.join(before, S.same_month_last_year(F.col("date")) == F.col("b_date"), "left")
    change = S.round_to(S.divide(F.col("avg_price") - F.col("b_price"), F.col("b_price")) * 100, 1)
    return out.select(F.col("date").alias("latest_date"), S.round_to(F.col("avg_price"), 2).alias("avg_price"), S.round_to(F.col("avg_psf"), 2).alias("avg_psf"), "transactions", change.alias("yoy_pct"))


def market_pulse(weeks: DataFrame) -> DataFrame:
    """One row over weekly_momentum(): the last week against the first and the peak; no row if there are no weeks."""
    whole = F.struct("week", "median", "median_pct_chg", "mean_median_ratio")
    one = weeks.agg(F.min_by(whole, F.struct("week")).alias("first"), F.max_by(whole, F.struct("week")).alias("last"), F.max("median").alias("peak_median")).filter("last is not null")
    first, last = F.col("first.median"), F.col("last.median")
    return one.select(
        F.col("last.week").alias("week"),
        last.alias("median"),
        F.col("last.median_pct_chg").alias("median_pct_chg"),
        S.round_to(S.divide(last - first, first) * 100, 1).alias("period_pct"),
        (last - first).alias("period_delta"),
        S.round_to(S.divide(last - F.col("peak_median"), F.col("peak_median")) * 100, 1).alias("from_peak_pct"),
        (last - F.col("peak_median")).alias("from_peak_delta"),
        "peak_median",
        F.col("last.mean_median_ratio").alias("mean_median_ratio"),
    )


def cheapest_areas(rolling: DataFrame, areas: list[str], n: int = 3) -> DataFrame:
    """The n areas whose latest rolling price is least, ties by name."""
    found = filters.members(rolling, "area", areas).filter(F.col("rolling_median_psf").isNotNull())
    latest = found.groupBy("area").agg(W.last_by(F.col("rolling_median_psf"), F.col("date")).alias("latest_median_psf"))
    return latest.orderBy("latest_median_psf", "area").limit(n)


def selected_prices(prices: AreaPrices, areas: list[str]) -> AreaPrices:
    return AreaPrices(*(filters.members(p, "area", areas) for p in prices))


def raw_table(daily: DataFrame) -> DataFrame:
    """Newest first, then by area and bedroom, with the date as text."""
    return daily.orderBy(F.col("date").desc_nulls_first(), "neighborhood", "bedroom_type").withColumn("date", S.day_text(F.col("date")))


def below_median(prices: AreaPrices) -> DataFrame:
    """Transactions cheaper than their area's rolling median of the day (an extension: the dots below the line)."""
    line = prices.rolling.filter(F.col("rolling_median_psf").isNotNull()).select("date", "area", "rolling_median_psf")
    return prices.transactions.join(line, ["date", "area"]).filter(F.col("price_per_sqft") < F.col("rolling_median_psf"))
