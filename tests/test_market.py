import datetime as dt

import pytest
from pyspark.sql import functions as F

from parcelflow.plans import market, report, views
from parcelflow.sinks import writers

# Published weekly figures: week, transactions, median, mean, their changes and the ratio.
WEEKS = [
    ("2026-02-02", 1441, 1140000.0, 1789178.0, None, None, 1.57),
    ("2026-02-09", 1814, 1107000.0, 1575200.0, 25.9, -2.9, 1.42),
    ("2026-02-16", 1529, 1090000.0, 1620078.0, -15.7, -1.5, 1.49),
    ("2026-02-23", 1802, 1100000.0, 1531076.0, 17.9, 0.9, 1.39),
    ("2026-03-02", 946, 1139419.0, 1637218.0, -47.5, 3.6, 1.44),
    ("2026-03-09", 1673, 801000.0, 1262779.0, 76.8, -29.7, 1.58),
    ("2026-03-16", 718, 1077696.0, 1735013.0, -57.1, 34.5, 1.61),
]
SCHEMA = "INSTANCE_DATE string, GROUP_EN string, IS_OFFPLAN_EN string, PROCEDURE_EN string, AREA_EN string, PROP_SB_TYPE_EN string, TRANS_VALUE double, ACTUAL_AREA double, ROOMS_EN string"


def tx(spark, rows):
    """rows: date, area, value, size, rooms."""
    return spark.createDataFrame([(d, "Sales", "Ready", None, a, "FLAT", v, s, r) for d, a, v, s, r in rows], SCHEMA)


@pytest.fixture(scope="module")
def weeks(spark):
    return market.momentum(spark.createDataFrame([w[:4] for w in WEEKS], "week string, txns long, median double, mean double").withColumn("week", F.to_date("week")))


def test_golden_weeks(weeks):
    got = weeks.collect()
    assert [(r["txn_pct_chg"], r["median_pct_chg"], r["mean_median_ratio"]) for r in got] == [w[4:] for w in WEEKS]


def test_pulse_volume_and_skew(weeks):
    r = market.market_pulse(weeks).first()
    assert (r["period_pct"], r["peak_median"], r["from_peak_pct"], r["mean_median_ratio"]) == (-5.5, 1140000.0, -5.5, 1.61)
    assert report.volume_shift(weeks).first()["pct_change"] == -30.2
    assert report.skew_shift(weeks).first()[:] == (1.57, 1.61)
    assert market.market_pulse(weeks.filter("false")).count() == 0
    card = writers.pulse_cards(market.market_pulse(weeks.limit(1))).first()
    assert card["weekly"] == "n/a" and card["median"] == "AED 1,140,000" and card["period_delta"] == "AED +0"


def test_daily_area_bedroom(spark):
    rows = [("2026-03-01", "A", 100.0, 10.0, "1 B/R"), ("2026-03-01", "A", 200.0, 0.0, "1 B/R"), ("2026-03-01", "A", None, 5.0, "1 B/R"), ("2026-03-01", "A", 7.0, 2.0, "Studio")]
    got = {r["bedroom_type"]: r for r in market.daily_area_bedroom(tx(spark, rows)).collect()}
    assert got["1BR"]["transaction_count"] == 2 and got["1BR"]["avg_price_aed"] == 150.0 and got["1BR"]["price_per_sqft_aed"] == float("inf") and got["1BR"]["avg_size_sqft"] == 5.0
    assert got["Studio"]["price_per_sqft_aed"] == 3.5


def test_counts_agree(spark):
    rows = [(f"2026-03-{d:02d}", a, float(d), 2.0, "1 B/R") for d in range(1, 29) for a in "AB"]
    t = tx(spark, rows)
    totals = [market.daily_market(t).agg(F.sum("transaction_count")).first()[0], market.weekly_momentum(t).agg(F.sum("txns")).first()[0], market.daily_area_bedroom(t).agg(F.sum("transaction_count")).first()[0]]
    assert totals == [56] * 3
    assert market.daily_market(t.orderBy(F.rand(1))).collect() == market.daily_market(t).collect()


def test_area_change(spark):
    rows = [("2026-03-02", "A", 100.0, 1.0, "1 B/R")] * 49 + [("2026-03-09", "A", 150.0, 1.0, "1 B/R")] + [("2026-03-02", "B", 1.0, 1.0, "1 B/R")] * 49
    got = market.area_change(tx(spark, rows)).collect()
    assert [r[:] for r in got] == [("A", 50, 100.0, 150.0, 50.0)]
    assert [r["direction"] for r in views.area_bars(market.area_change(tx(spark, rows))).collect()] == ["up"]
    assert report.area_moves(tx(spark, rows), falling=False).count() == 1 and report.area_moves(tx(spark, rows)).count() == 0
    zero = [("2026-03-02", "Z", 0.0, 1.0, "1 B/R")] * 50 + [("2026-03-09", "Z", 5.0, 1.0, "1 B/R")]
    assert market.area_change(tx(spark, zero)).first()["pct_change"] == float("inf")


def test_rolling_needs_all_rows(spark):
    days = [dt.date(2026, 1, 1) + dt.timedelta(days=3 * i) for i in range(14)]
    prices = market.area_prices(tx(spark, [(str(d), "a", 100.0 + i, 1.0, "1 B/R") for i, d in enumerate(days)]))
    got = [r["rolling_median_psf"] for r in prices.rolling.collect()]
    assert got == [None] * 13 + [106.5]
    assert market.cheapest_areas(prices.rolling, ["A"]).first()[:] == ("A", 106.5)
    assert writers.area_cards(market.cheapest_areas(prices.rolling, ["A"])).first()["area"] == "A"
    assert market.below_median(prices).count() == 0
    assert market.area_prices(tx(spark, [("2026-01-01", "a", 1.0, 0.0, "1 B/R")])).transactions.count() == 0
    lines = views.area_price_lines(prices, ["B", "A"])
    assert lines.rolling.first()["area_order"] == 1


def test_tiers(spark):
    t = tx(spark, [("2026-03-01", "PALM JUMEIRAH", 10.0, 1.0, "1 B/R"), ("2026-03-01", "NOWHERE", 99.0, 1.0, "1 B/R")])
    got = market.tier_daily(t).collect()
    assert [(r["tier"], r["median_price"], r["txns"], r["median_7d"]) for r in got] == [("Premium", 10.0, 1, None)]
    assert views.tier_lines(market.tier_daily(t)).first()["tier_order"] == 1


def test_headline(spark):
    rows = [("2026-03-05", "A", 120.0, 1.0, "1 B/R"), ("2025-03-01", "A", 100.0, 1.0, "1 B/R")]
    daily = market.daily_area_bedroom(tx(spark, rows))
    r = market.headline(daily).first()
    assert (r["avg_price"], r["transactions"], r["yoy_pct"]) == (120.0, 1, 20.0)
    card = writers.kpi_cards(market.headline(daily.filter("date > '2026-01-01'"))).first()
    assert (card["yoy"], card["avg_price"], card["as_of"]) == ("N/A", "AED 120", "Mar 2026")
    assert market.headline(daily.filter("false")).count() == 0


def test_empty_snapshot(spark):
    from parcelflow import schema

    e = schema.empty(spark)
    for kind in ("All", "Sale", "Mortgage", "Off-Plan"):
        assert market.weekly_momentum(e, kind).count() == 0 and market.tier_daily(e, kind).count() == 0 and market.area_change(e, kind).count() == 0
    assert all(df.count() <= 1 for df in report.report(e).values())


def test_sinks(spark, tmp_path):
    t = tx(spark, [("2026-03-01", 'A, "b"', 1.0, 1.0, None)])
    writers.to_csv(market.raw_table(market.daily_area_bedroom(t)), f"{tmp_path}/csv", single=True)
    r = spark.read.option("header", True).option("escape", "\\").csv(f"{tmp_path}/csv").first()
    assert r["neighborhood"] == 'A, "b"' and r["bedroom_type"] is None
    writers.to_table(t, f"{tmp_path}/table")
    assert spark.read.parquet(f"{tmp_path}/table").filter("month = '2026-03'").count() == 1
    assert "## Weekly momentum" in writers.to_markdown(report.report(t))
