"""Every registered query, over transactions derived from the supplied tables, each with an independent SQL oracle."""

from __future__ import annotations

import datetime as dt
import json
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parcelflow import schema
from parcelflow.functions import scalars as S
from parcelflow.functions import windows as W
from parcelflow.operators import filters, normalize
from parcelflow.plans import fixture, market, report, views
from parcelflow.sinks import writers
from parcelflow.sources import files, paged, snapshot
from parcelflow.sources.standin import Standin

START, END = dt.date(1996, 1, 1), dt.date(1998, 12, 31)
PICKED = ["NATION_0", "NATION_3", "NATION_7", "NATION_22"]

QUERIES: dict = {}
ORACLES: dict = {}


def _sql(area: str = "upper(n_name)", zero: str = "l_quantity") -> str:
    return f"""tx AS (SELECT CAST(o_orderdate AS DATE) AS date,
  CASE o_orderstatus WHEN 'F' THEN 'Sales' WHEN 'O' THEN 'Mortgage' ELSE 'Other' END AS grp,
  CASE l_linestatus WHEN 'O' THEN 'Off-Plan' ELSE 'Ready' END AS status, {area} AS area,
  CASE p_type WHEN 'ECONOMY' THEN 'Flat' ELSE p_type END AS kind, l_extendedprice AS value, {zero} AS size,
  CASE l_linenumber WHEN 1 THEN 'Studio' ELSE (l_linenumber - 1)::VARCHAR || ' B/R' END AS rooms,
  CASE l_linenumber WHEN 1 THEN 'Studio' ELSE (l_linenumber - 1)::VARCHAR || 'BR' END AS bed,
  CASE WHEN l_linenumber <> 2 THEN l_linenumber % 2 = 1 END AS free,
  CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'Sale On Payment Plan' WHEN '2' THEN 'Development Registration' WHEN '5' THEN NULL ELSE 'Sale' END AS proc
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""


# Pieces of the oracles, building on each other.
TX, TX0, TXC = _sql(), _sql(zero="l_quantity - 1"), _sql(area="o_custkey::VARCHAR")
FLAT = "flat AS (SELECT * FROM tx WHERE lower(kind) = 'flat')"
OFF = "(lower(status) LIKE '%off%' OR coalesce(lower(proc) LIKE '%development%' OR lower(proc) LIKE '%payment plan%', false))"
DIV = "CASE WHEN size = 0 THEN CASE WHEN value > 0 THEN 'inf'::DOUBLE WHEN value < 0 THEN '-inf'::DOUBLE ELSE 'nan'::DOUBLE END ELSE value / size END"


def _round(x: str, digits: int = 0) -> str:
    return f"(round(({x}) * {10.0**digits}, 0) / {10.0**digits} + 0.0)" if digits else f"(round({x}, 0) + 0.0)"


DAILY = f"""daily AS (SELECT date, area AS neighborhood, bed AS bedroom_type, {_round('avg(value)')} AS avg_price_aed, {_round(f'avg({DIV})', 1)} AS price_per_sqft_aed,
 {_round('avg(size)', 1)} AS avg_size_sqft, count(value) AS transaction_count FROM flat GROUP BY ALL)"""
SELECTED = f"sel AS (SELECT * FROM daily WHERE neighborhood IN ({', '.join(repr(p) for p in PICKED)}) AND date BETWEEN DATE '{START}' AND DATE '{END}')"
DAYS = f"days AS (SELECT date, count(value) AS transaction_count, {_round('median(value)')} AS median_price_aed, {_round('avg(value)')} AS avg_price_aed FROM flat GROUP BY date)"
WEEKS = f"""w0 AS (SELECT CAST(date_trunc('week', date) AS DATE) AS week, count(value) AS txns, {_round('median(value)')} AS median, {_round('avg(value)')} AS mean FROM flat GROUP BY 1),
weeks AS (SELECT week, txns, median, mean, {_round('(median - lag(median) OVER o) / lag(median) OVER o * 100', 1)} AS median_pct_chg, {_round('(mean - lag(mean) OVER o) / lag(mean) OVER o * 100', 1)} AS mean_pct_chg,
 {_round('(txns - lag(txns) OVER o)::DOUBLE / lag(txns) OVER o * 100', 1)} AS txn_pct_chg, {_round('mean / median', 2)} AS mean_median_ratio FROM w0 WINDOW o AS (ORDER BY week))"""
AREAS = f"""aw AS (SELECT area, CAST(date_trunc('week', date) AS DATE) AS week, count(value) AS txns, {_round('median(value)')} AS median FROM src GROUP BY 1, 2),
areas AS (SELECT area, CAST(sum(txns) AS BIGINT) AS total_txns, arg_min(median, week) AS first_median, arg_max(median, week) AS last_median,
 {_round('(arg_max(median, week) - arg_min(median, week)) / arg_min(median, week) * 100', 1)} AS pct_change FROM aw GROUP BY area HAVING sum(txns) >= 50)"""
TIERS = """tiers AS (SELECT 'NATION_' || i AS tier_area, ['Ultra-premium', 'Premium', 'Mid-market', 'Value', 'Budget'][CAST(floor(i / 4) AS INT) + 1] AS tier, CAST(floor(i / 4) AS INT) AS tier_order FROM range(20) t(i))"""
TIERDAY = f"""td AS (SELECT date, tier, {_round('median(value)')} AS median_price, count(value) AS txns FROM flat JOIN tiers ON area = tier_area GROUP BY ALL),
tierday AS (SELECT *, CASE WHEN count(median_price) OVER f >= 7 THEN avg(median_price) OVER f END AS median_7d FROM td WINDOW f AS (PARTITION BY tier ORDER BY date ROWS 6 PRECEDING))"""
PSF = f"""psf AS (SELECT date, upper(area) AS area, bed, value / size AS price_per_sqft FROM flat WHERE size > 0),
pd AS (SELECT date, area, {_round('median(price_per_sqft)')} AS daily_median_psf FROM psf GROUP BY ALL),
roll AS (SELECT *, CASE WHEN count(daily_median_psf) OVER f >= 14 THEN avg(daily_median_psf) OVER f END AS rolling_median_psf FROM pd WINDOW f AS (PARTITION BY area ORDER BY date ROWS 13 PRECEDING))"""


def _tx(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixture.transactions(spark, sf_dir)


def _tx0(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixture.transactions(spark, sf_dir, zero_areas=True)


def _txc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as areas, all kinds of property: many small areas, so that the least count bites."""
    return fixture.transactions(spark, sf_dir, area="customer").withColumn("PROP_SB_TYPE_EN", F.lit("Flat"))


def _add(name: str, build, *parts: str) -> None:
    QUERIES[name] = build
    if parts:
        *ctes, last = parts
        ORACLES[name] = f"WITH {', '.join(ctes)} {last}" if ctes else last


def _daily(s: SparkSession, d: str) -> DataFrame:
    return market.filtered_daily(_tx(s, d), PICKED, filters.ALL, START, END)


# Composite queries
_add("weekly_momentum", lambda s, d: market.weekly_momentum(_tx(s, d)), TX, FLAT, WEEKS, "SELECT * FROM weeks")
_add("daily_market", lambda s, d: market.daily_market(_tx(s, d)), TX, FLAT, DAYS, "SELECT * FROM days")
_add("daily_area_bedroom", lambda s, d: market.daily_area_bedroom(_tx0(s, d)), TX0, FLAT, DAILY, "SELECT * FROM daily")
_add("area_first_last_week", lambda s, d: market.area_change(_txc(s, d)), TXC, "src AS (SELECT * FROM tx)", AREAS, "SELECT * FROM areas")
_add("tier_daily_rolling", lambda s, d: market.tier_daily(_tx(s, d), tiers=fixture.tiers(s)), TX, FLAT, TIERS, TIERDAY, "SELECT * FROM tierday")
_add("psf_transactions", lambda s, d: market.area_prices(_tx0(s, d)).transactions, TX0, FLAT, PSF, "SELECT date, area, price_per_sqft FROM psf")
_add("psf_rolling", lambda s, d: market.area_prices(_tx0(s, d)).rolling, TX0, FLAT, PSF, "SELECT * FROM roll")
_add("filtered_daily", lambda s, d: market.filtered_daily(_tx(s, d), PICKED, "2BR", START, END), TX, FLAT, DAILY, SELECTED, "SELECT * FROM sel WHERE bedroom_type = '2BR'")
_add(
    "headline_kpis",
    lambda s, d: market.headline(market.filtered_daily(_tx(s, d), [*fixture.AREA_NAMES], filters.ALL, dt.date(1996, 1, 1), dt.date(1997, 12, 15))),
    TX, FLAT, DAILY,
    "sel AS (SELECT * FROM daily WHERE date BETWEEN DATE '1996-01-01' AND DATE '1997-12-15')",
    "k AS (SELECT date, avg(avg_price_aed) AS p, avg(price_per_sqft_aed) AS q, CAST(sum(transaction_count) AS BIGINT) AS n FROM sel GROUP BY date), m AS (SELECT * FROM k ORDER BY date DESC LIMIT 1)",
    f"SELECT m.date AS latest_date, {_round('m.p', 2)} AS avg_price, {_round('m.q', 2)} AS avg_psf, m.n AS transactions, {_round('(m.p - b.p) / b.p * 100', 1)} AS yoy_pct "
    "FROM m LEFT JOIN k b ON b.date = CAST(date_trunc('month', m.date - INTERVAL 12 MONTH) AS DATE)",
)
_add(
    "market_pulse",
    lambda s, d: market.market_pulse(market.weekly_momentum(_tx(s, d))),
    TX, FLAT, WEEKS,
    "a AS (SELECT arg_min(median, week) AS f, max(median) AS peak FROM weeks), l AS (SELECT * FROM weeks ORDER BY week DESC LIMIT 1)",
    f"SELECT week, median, median_pct_chg, {_round('(median - f) / f * 100', 1)} AS period_pct, median - f AS period_delta, {_round('(median - peak) / peak * 100', 1)} AS from_peak_pct, median - peak AS from_peak_delta, peak AS peak_median, mean_median_ratio FROM l, a",
)
_add("cheapest_areas", lambda s, d: market.cheapest_areas(market.area_prices(_tx0(s, d)).rolling, PICKED), TX0, FLAT, PSF, f"SELECT area, arg_max(rolling_median_psf, date) AS latest_median_psf FROM roll WHERE rolling_median_psf IS NOT NULL AND area IN ({', '.join(repr(p) for p in PICKED)}) GROUP BY area ORDER BY 2, 1 LIMIT 3")
_add("raw_table", lambda s, d: market.raw_table(_daily(s, d)), TX, FLAT, DAILY, SELECTED, "SELECT * REPLACE (strftime(date, '%Y-%m-%d') AS date) FROM sel")
_add("filtered_psf", lambda s, d: market.selected_prices(market.area_prices(_tx0(s, d), bedroom="1BR"), PICKED).rolling, TX0, FLAT, PSF.replace("WHERE size > 0", "WHERE size > 0 AND bed = '1BR'"), f"SELECT * FROM roll WHERE area IN ({', '.join(repr(p) for p in PICKED)})")
_add("deal_below_median", lambda s, d: market.below_median(market.area_prices(_tx0(s, d))), TX0, FLAT, PSF, "SELECT date, area, price_per_sqft, rolling_median_psf FROM psf JOIN roll USING (date, area) WHERE price_per_sqft < rolling_median_psf")

# Datasets of the charts
_add("price_lines", lambda s, d: views.price_lines(_daily(s, d), PICKED), TX, FLAT, DAILY, SELECTED, f"SELECT list_position({PICKED!r}, neighborhood) - 1 AS area_order, neighborhood, bedroom_type, date, avg_price_aed FROM sel")
_add(
    "bar_latest_pivot",
    lambda s, d: views.latest_bars(_daily(s, d), ["1BR", "2BR", "3BR", "Studio"]),
    TX, FLAT, DAILY, SELECTED,
    'SELECT neighborhood, ' + ", ".join(f"max(CASE WHEN bedroom_type = '{b}' THEN avg_price_aed END) AS \"{b}\"" for b in ("1BR", "2BR", "3BR", "Studio")) + " FROM sel WHERE date = (SELECT max(date) FROM sel) GROUP BY neighborhood",
)
_add("price_scatter", lambda s, d: views.price_scatter(_daily(s, d)), TX, FLAT, DAILY, SELECTED, "SELECT date, bedroom_type, neighborhood, avg_price_aed, transaction_count FROM sel")
_add("volume_daily", lambda s, d: views.daily_volume(market.daily_market(_tx(s, d))), TX, FLAT, DAYS, "SELECT date, transaction_count FROM days")
_add(
    "daily_rolling7",
    lambda s, d: views.daily_trend(market.daily_market(_tx(s, d))),
    TX, FLAT, DAYS,
    "SELECT date, median_price_aed, avg_price_aed, CASE WHEN count(*) OVER f >= 7 THEN avg(median_price_aed) OVER f END AS median_7d, CASE WHEN count(*) OVER f >= 7 THEN avg(avg_price_aed) OVER f END AS avg_7d FROM days WINDOW f AS (ORDER BY date ROWS 6 PRECEDING)",
)
_add("sign_class_weekly", lambda s, d: views.weekly_bars(market.weekly_momentum(_tx(s, d))), TX, FLAT, WEEKS, "SELECT week, median_pct_chg, CASE WHEN median_pct_chg < 0 THEN 'down' ELSE 'up' END AS direction FROM weeks")
_add("sign_class_area", lambda s, d: views.area_bars(market.area_change(_txc(s, d))), TXC, "src AS (SELECT * FROM tx)", AREAS, "SELECT area, pct_change, CASE WHEN pct_change < 0 THEN 'down' ELSE 'up' END AS direction FROM areas")
_add("tier_lines", lambda s, d: views.tier_lines(market.tier_daily(_tx(s, d), tiers=fixture.tiers(s)), fixture.tiers(s)), TX, FLAT, TIERS, TIERDAY, "SELECT tier_order, tier, date, median_price, median_7d FROM tierday JOIN (SELECT DISTINCT tier, tier_order FROM tiers) USING (tier)")
_add("area_price_lines", lambda s, d: views.area_price_lines(market.area_prices(_tx0(s, d)), PICKED).rolling, TX0, FLAT, PSF, f"SELECT area, date, daily_median_psf, rolling_median_psf, list_position({PICKED!r}, area) - 1 AS area_order FROM roll WHERE area IN ({', '.join(repr(p) for p in PICKED)})")

# Sections of the report
_add("price_quantiles", lambda s, d: report.structure(_tx0(s, d)), TX0, FLAT, f"SELECT count(value) AS txns, {_round('median(value)')} AS median, {_round('avg(value)')} AS mean, {_round('avg(value) / median(value)', 2)} AS ratio, {_round('median(CASE WHEN size > 0 THEN value / size END)')} AS median_psf, {_round('quantile_cont(value, 0.1)')} AS p10, {_round('quantile_cont(value, 0.25)')} AS p25, {_round('quantile_cont(value, 0.75)')} AS p75, {_round('100.0 * count(*) FILTER (free) / count(free)', 1)} AS freehold_pct, {_round('median(value) FILTER (free)')} AS freehold_median, {_round('median(value) FILTER (NOT free)')} AS leasehold_median FROM flat")
_add("concentration_topn", lambda s, d: report.concentration(_tx(s, d)), TX, FLAT, f"g AS (SELECT area, count(value) AS txns FROM flat GROUP BY area), r AS (SELECT row_number() OVER (ORDER BY txns DESC, area) AS rank, area, txns, {_round('sum(txns) OVER (ORDER BY txns DESC, area ROWS UNBOUNDED PRECEDING)::DOUBLE / sum(txns) OVER () * 100', 1)} AS cumulative_pct FROM g)", "SELECT * FROM r WHERE rank <= 10")
_add("tier_prices", lambda s, d: report.tier_prices(_tx0(s, d), tiers=fixture.tiers(s)), TX0, FLAT, TIERS, f"SELECT tier_order, tier, {_round('median(value / size)')} AS median_psf, count(value) AS txns FROM flat JOIN tiers ON area = tier_area WHERE size > 0 GROUP BY ALL")
MOVES = f"""mw AS (SELECT area, CAST(date_trunc('week', date) AS DATE) AS week, count(value) AS txns, {_round('median(value)')} AS median, {_round('median(CASE WHEN size > 0 THEN value / size END)')} AS psf FROM src GROUP BY 1, 2),
m1 AS (SELECT area, CAST(sum(txns) AS BIGINT) AS total_txns, arg_min(median, week) AS first_median, arg_max(median, week) AS last_median, arg_min_null(psf, week) AS first_psf, arg_max_null(psf, week) AS last_psf FROM mw GROUP BY area HAVING sum(txns) >= {{least}}),
moves AS (SELECT *, {_round('(last_median - first_median) / first_median * 100', 1)} AS pct_change, {_round('(last_psf - first_psf) / first_psf * 100', 1)} AS psf_pct_change FROM m1)"""
_add("falling_areas", lambda s, d: report.area_moves(_txc(s, d)), TXC, "src AS (SELECT * FROM tx)", MOVES.format(least=50), "SELECT * FROM moves WHERE pct_change < 0")
_add("falling_areas_1br", lambda s, d: report.area_moves(_txc(s, d), bedroom="1BR", least=8), TXC, "src AS (SELECT * FROM tx WHERE bed = '1BR')", MOVES.format(least=8), "SELECT * FROM moves WHERE pct_change < 0")
_add("rising_areas", lambda s, d: report.area_moves(_txc(s, d), falling=False), TXC, "src AS (SELECT * FROM tx)", MOVES.format(least=50), "SELECT * FROM moves WHERE pct_change > 0")
_add("volume_shift", lambda s, d: report.volume_shift(market.weekly_totals(_tx(s, d))), TX, FLAT, WEEKS, f"v AS (SELECT CAST((SELECT sum(txns) FROM (SELECT txns FROM weeks ORDER BY week LIMIT 3)) AS BIGINT) AS first_txns, CAST((SELECT sum(txns) FROM (SELECT txns FROM weeks ORDER BY week DESC LIMIT 3)) AS BIGINT) AS last_txns)", f"SELECT *, {_round('(last_txns - first_txns)::DOUBLE / first_txns * 100', 1)} AS pct_change FROM v")
_add("skew_shift", lambda s, d: report.skew_shift(market.weekly_momentum(_tx(s, d))), TX, FLAT, WEEKS, "SELECT arg_min(mean_median_ratio, week) AS first_ratio, arg_max(mean_median_ratio, week) AS last_ratio FROM weeks")
_add("steepest_declines", lambda s, d: report.steepest_declines(_txc(s, d)), TXC, "src AS (SELECT * FROM tx)", AREAS, "SELECT * FROM areas WHERE pct_change < 0 ORDER BY pct_change, area LIMIT 3")

# Filters
_PLAIN = ["date", "AREA_EN", "GROUP_EN", "IS_OFFPLAN_EN", "PROCEDURE_EN", "TRANS_VALUE"]
_SPLAIN = 'date, area AS "AREA_EN", grp AS "GROUP_EN", status AS "IS_OFFPLAN_EN", proc AS "PROCEDURE_EN", value AS "TRANS_VALUE"'
for _name, _kind, _where in (("type_all", "All", "true"), ("type_sale", "Sale", "lower(grp) = 'sales'"), ("type_mortgage", "Mortgage", "lower(grp) = 'mortgage'"), ("type_offplan", "Off-Plan", OFF)):
    _add(_name, lambda s, d, k=_kind: market.base(_tx(s, d), k).select(_PLAIN), TX, FLAT, f"SELECT {_SPLAIN} FROM flat WHERE {_where}")
_add("flat_only", lambda s, d: filters.property_type(_tx(s, d)).select(_PLAIN), TX, f"SELECT {_SPLAIN} FROM tx WHERE lower(kind) = 'flat'")
_add("area_membership", lambda s, d: filters.members(_tx(s, d), "AREA_EN", PICKED).select(_PLAIN), TX, f"SELECT {_SPLAIN} FROM tx WHERE area IN ({', '.join(repr(p) for p in PICKED)})")
_add("date_range", lambda s, d: filters.day_range(_tx(s, d), START, END).select(_PLAIN), TX, f"SELECT {_SPLAIN} FROM tx WHERE date >= DATE '{START}' AND date <= DATE '{END}'")
_add("bedroom_eq", lambda s, d: filters.equal_unless_all(_tx(s, d).withColumn("bedroom_type", S.bedroom(F.col("ROOMS_EN"))), "bedroom_type", "Studio").select(*_PLAIN, "bedroom_type"), TX, f"SELECT {_SPLAIN}, bed AS bedroom_type FROM tx WHERE bed = 'Studio'")
_add("positive_area", lambda s, d: filters.positive_area(_tx0(s, d)).select(*_PLAIN, "ACTUAL_AREA"), TX0, f'SELECT {_SPLAIN}, size AS "ACTUAL_AREA" FROM tx WHERE size > 0')
_add("latest_slice", lambda s, d: filters.at_latest(_tx(s, d)).select(_PLAIN), TX, f"SELECT {_SPLAIN} FROM tx WHERE date = (SELECT max(date) FROM tx)")
_add("having_min50", lambda s, d: _txc(s, d).groupBy("AREA_EN").agg(F.count("TRANS_VALUE").alias("n")).filter("n >= 50"), TXC, 'SELECT area AS "AREA_EN", count(value) AS n FROM tx GROUP BY area HAVING count(value) >= 50')
_add("not_null", lambda s, d: _tx(s, d).filter("PROCEDURE_EN is not null").select(_PLAIN), TX, f"SELECT {_SPLAIN} FROM tx WHERE proc IS NOT NULL")

# Joins, ordering, scalar and window functions
_add("distinct_areas", lambda s, d: _tx(s, d).select("AREA_EN").distinct(), TX, 'SELECT DISTINCT area AS "AREA_EN" FROM tx')
_add(
    "inner_join_area",
    lambda s, d: _tx(s, d).groupBy("AREA_EN").agg(F.count("TRANS_VALUE").alias("n")).join(_tx(s, d).filter("GROUP_EN = 'Sales'").groupBy("AREA_EN").agg(F.max("TRANS_VALUE").alias("top_sale")), "AREA_EN"),
    TX, 'SELECT a.area AS "AREA_EN", n, top_sale FROM (SELECT area, count(value) AS n FROM tx GROUP BY area) a JOIN (SELECT area, max(value) AS top_sale FROM tx WHERE grp = \'Sales\' GROUP BY area) b ON a.area = b.area',
)
_add("tier_lookup", lambda s, d: _tx(s, d).join(F.broadcast(fixture.tiers(s)), F.col("AREA_EN") == F.col("tier_area")).groupBy("tier").agg(F.count(F.lit(1)).alias("n")), TX, TIERS, "SELECT tier, count(*) AS n FROM tx JOIN tiers ON area = tier_area GROUP BY tier")
_add("topk", lambda s, d: _tx(s, d).groupBy("AREA_EN").agg(F.max("TRANS_VALUE").alias("top")).orderBy("top", "AREA_EN").limit(3), TX, 'SELECT area AS "AREA_EN", max(value) AS top FROM tx GROUP BY area ORDER BY 2, 1 LIMIT 3')
_add("sort_mixed", lambda s, d: market.daily_area_bedroom(_tx(s, d)).orderBy(F.col("date").desc_nulls_first(), "neighborhood", "bedroom_type").select("date", "neighborhood", "bedroom_type"), TX, FLAT, DAILY, "SELECT date, neighborhood, bedroom_type FROM daily ORDER BY 1 DESC, 2, 3")
_add("ieee_div", lambda s, d: _tx0(s, d).groupBy(F.col("ACTUAL_AREA").cast("long").alias("size")).agg(S.divide(F.count(F.lit(1)), F.first("ACTUAL_AREA")).alias("ratio")), TX0, "SELECT size::BIGINT AS size, CASE WHEN size = 0 THEN 'inf'::DOUBLE ELSE count(*) / size END AS ratio FROM tx GROUP BY tx.size")
_add("replace_first", lambda s, d: _tx(s, d).select(S.replace_first(F.concat("ROOMS_EN", F.lit(" B/R")), " B/R", "BR").alias("label")).distinct(), TX, "SELECT DISTINCT CASE rooms WHEN 'Studio' THEN 'StudioBR' ELSE bed || ' B/R' END AS label FROM tx")
_add("week_trunc", lambda s, d: _tx(s, d).select("date", S.week_of(F.col("date")).alias("week")).distinct(), TX, "SELECT DISTINCT date, date - CAST(isodow(date) - 1 AS INT) AS week FROM tx")
_add("months_before", lambda s, d: _tx(s, d).select("date", *[S.months_earlier(F.col("date"), n).alias(f"m{n}") for n in (1, 4, 12)]).distinct(), TX, "SELECT DISTINCT date, CAST(date - INTERVAL 1 MONTH AS DATE) AS m1, CAST(date - INTERVAL 4 MONTH AS DATE) AS m4, CAST(date - INTERVAL 12 MONTH AS DATE) AS m12 FROM tx")
_add("same_month_last_year", lambda s, d: _tx(s, d).select("date", S.same_month_last_year(F.col("date")).alias("before")).distinct(), TX, "SELECT DISTINCT date, make_date(year(date) - 1, month(date), 1) AS before FROM tx")
_add("pct_change", lambda s, d: _tx(s, d).groupBy("date").agg(F.count(F.lit(1)).alias("n")).withColumn("change", S.round_to(W.pct_change(F.col("n"), Window.orderBy("date")) * 100, 1)), TX, f"c AS (SELECT date, count(*) AS n FROM tx GROUP BY date)", f"SELECT date, n, {_round('(n - lag(n) OVER (ORDER BY date))::DOUBLE / lag(n) OVER (ORDER BY date) * 100', 1)} AS change FROM c")
_add("first_last_by", lambda s, d: _tx(s, d).groupBy("date", "AREA_EN").agg(F.min("TRANS_VALUE").alias("v")).groupBy("AREA_EN").agg(W.first_by(F.col("v"), F.col("date")).alias("first_v"), W.last_by(F.col("v"), F.col("date")).alias("last_v")), TX, 'SELECT area AS "AREA_EN", arg_min(v, date) AS first_v, arg_max(v, date) AS last_v FROM (SELECT date, area, min(value) AS v FROM tx GROUP BY ALL) GROUP BY area')
_add("title_case", lambda s, d: _tx(s, d).select(S.title_case(F.concat("AREA_EN", F.lit(" al-barari"))).alias("title")).distinct(), TX, "SELECT DISTINCT 'Nation_' || substr(area, 8) || ' Al-Barari' AS title FROM tx")

# Normalising and validation
_RAW = """raw AS (SELECT l_orderkey || '-' || l_linenumber AS id, l_linenumber AS n, l_quantity, l_extendedprice AS price, CAST(o_orderdate AS DATE) AS day, o_orderstatus, l_linestatus, l_returnflag
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def _normal(s: SparkSession, d: str) -> DataFrame:
    return normalize.normalize(fixture.raw(s, d))


_ID = '"TRANSACTION_NUMBER"'
_add("normalize_dates", lambda s, d: _normal(s, d).select("TRANSACTION_NUMBER", "INSTANCE_DATE"), _RAW, f"SELECT id AS {_ID}, CASE WHEN n <> 5 THEN strftime(day, '%Y-%m-%d') END AS \"INSTANCE_DATE\" FROM raw")
_add("normalize_numbers", lambda s, d: _normal(s, d).select("TRANSACTION_NUMBER", "TRANS_VALUE"), _RAW, f'SELECT id AS {_ID}, CASE WHEN n <> 3 THEN price END AS "TRANS_VALUE" FROM raw')
_add("normalize_rooms", lambda s, d: _normal(s, d).select("TRANSACTION_NUMBER", "ROOMS_EN"), _RAW, f"SELECT id AS {_ID}, CASE n WHEN 1 THEN 'Studio' WHEN 2 THEN 'Office' WHEN 3 THEN '2 B/R' ELSE (n - 1)::VARCHAR || ' B/R' END AS \"ROOMS_EN\" FROM raw")
_add("normalize_strings", lambda s, d: _normal(s, d).select("TRANSACTION_NUMBER", "GROUP_EN", "IS_OFFPLAN_EN", "AREA_EN"), _RAW, f"SELECT id AS {_ID}, CASE o_orderstatus WHEN 'F' THEN 'Sales' WHEN 'O' THEN 'Mortgage' END AS \"GROUP_EN\", CASE l_linestatus WHEN 'O' THEN 'Off-Plan' ELSE 'Ready' END AS \"IS_OFFPLAN_EN\", 'AREA ' || l_returnflag AS \"AREA_EN\" FROM raw")
_add("coalesce_aliases", lambda s, d: _normal(s, d).select("TRANSACTION_NUMBER", "ACTUAL_AREA", "PROCEDURE_AREA"), _RAW, f'SELECT id AS {_ID}, l_quantity AS "ACTUAL_AREA", l_quantity AS "PROCEDURE_AREA" FROM raw')
_add("optional_columns", lambda s, d: _normal(s, d).agg(*[F.count(c).alias(c) for c in schema.OPTIONAL]), _RAW, "SELECT " + ", ".join(f'{"count(*)" if c in ("TRANSACTION_NUMBER", "PROCEDURE_AREA") else "CAST(0 AS BIGINT)"} AS "{c}"' for c in schema.OPTIONAL) + " FROM raw")
_add(
    "validate_columns",
    lambda s, d: normalize.validate(_normal(s, d).drop("ROOMS_EN")),
    _RAW,
    "SELECT c AS column, c <> 'ROOMS_EN' AS present, CAST(CASE c WHEN 'ROOMS_EN' THEN 0 WHEN 'INSTANCE_DATE' THEN (SELECT count(*) FROM raw WHERE n <> 5) WHEN 'GROUP_EN' THEN (SELECT count(*) FROM raw WHERE o_orderstatus IN ('F', 'O')) "
    "WHEN 'TRANS_VALUE' THEN (SELECT count(*) FROM raw WHERE n <> 3) ELSE (SELECT count(*) FROM raw) END AS BIGINT) AS non_null, c = 'ROOMS_EN' AS missing, (SELECT count(*) FROM raw) AS row_count "
    f"FROM (SELECT unnest([{', '.join(repr(c) for c in schema.REQUIRED)}]) AS c)",
)
_add("date_bounds", lambda s, d: normalize.date_bounds(_normal(s, d)), _RAW, "SELECT min(day) AS first_date, max(day) AS last_date FROM raw WHERE n <> 5")
_add("strict_dates", lambda s, d: market.base(_tx(s, d).drop("date"), strict=True).groupBy("date").agg(F.count(F.lit(1)).alias("n")), TX, FLAT, "SELECT date, count(*) AS n FROM flat GROUP BY date")
_add("raw_coverage", lambda s, d: normalize.raw_coverage(fixture.raw(s, d).withColumnRenamed("Instance Date", "instance_date")), _RAW, "SELECT min(substr(t, 1, 10)) AS first_text, max(substr(t, 1, 10)) AS last_text FROM (SELECT CASE n WHEN 1 THEN strftime(day, '%Y-%m-%d 00:00:00') WHEN 2 THEN strftime(day, '%Y-%m-%dT00:00:00') WHEN 3 THEN strftime(day, '%d-%m-%Y') WHEN 4 THEN strftime(day, '%d/%m/%Y') WHEN 5 THEN 'not a date' ELSE ' ' || strftime(day, '%Y-%m-%d') || chr(9) END AS t FROM raw)")


def _mapping(s: SparkSession, d: str) -> DataFrame:
    found = normalize.resolve_columns(fixture.raw(s, d).columns)
    return s.createDataFrame([(k, i, c) for k, v in found.items() for i, c in enumerate(v)], "target string, place int, source string")


_add(
    "column_mapping", _mapping,
    "SELECT * FROM (VALUES ('INSTANCE_DATE', 0, 'Instance Date'), ('GROUP_EN', 0, 'trans_group_en'), ('IS_OFFPLAN_EN', 0, 'reg_type_en'), ('AREA_EN', 0, 'area_name_en'), ('PROP_SB_TYPE_EN', 0, 'property_sub_type_en'), ('TRANS_VALUE', 0, 'actual_worth'), "
    "('ACTUAL_AREA', 0, 'actual_area'), ('ACTUAL_AREA', 1, 'procedure_area'), ('ROOMS_EN', 0, 'rooms_en'), ('TRANSACTION_NUMBER', 0, 'transaction-id'), ('PROCEDURE_AREA', 0, 'procedure_area')) t(target, place, source)",
)
_add("table_shape", lambda s, d: s.createDataFrame([(_tx(s, d).count(), len(_tx(s, d).columns), schema.empty(s).isEmpty())], "rows long, columns int, empty_is_empty boolean"), TX, "SELECT count(*) AS rows, 11 AS columns, true AS empty_is_empty FROM tx")
_add("area_membership_long", lambda s, d: filters.members(_txc(s, d), "AREA_EN", [str(i) for i in range(1, 1401, 2)]).select(_PLAIN), TXC, f"SELECT {_SPLAIN} FROM tx WHERE CAST(area AS INT) % 2 = 1 AND CAST(area AS INT) BETWEEN 1 AND 1400")
_D = lambda *x: dt.date(2026, *x)
_RANGES = [(_D(1, 1), _D(2, 1)), (_D(1, 20), _D(3, 20)), (_D(1, 1), _D(1, 31)), (_D(2, 10), _D(2, 20)), (_D(3, 1), _D(2, 1)), (_D(5, 1), _D(6, 1))]
_add(
    "range_clamp", lambda s, d: s.createDataFrame([(*r, *filters.clamp(*r, _D(1, 15), _D(3, 15))) for r in _RANGES], "first date, last date, from_day date, to_day date"),
    f"r AS (SELECT * FROM (VALUES {', '.join(f'(DATE {str(a)!r}, DATE {str(b)!r})' for a, b in _RANGES)}) t(first, last)), c AS (SELECT *, greatest(first, DATE '2026-01-15') AS a, least(last, DATE '2026-03-15') AS b FROM r)",
    "SELECT first, last, CASE WHEN a <= b THEN a ELSE DATE '2026-01-15' END AS from_day, CASE WHEN a <= b THEN b ELSE DATE '2026-03-15' END AS to_day FROM c",
)
_ENDS = [dt.date(2026, 3, 31), dt.date(2024, 2, 29), dt.date(2025, 12, 31), dt.date(2026, 1, 1)]
_add("last_months", lambda s, d: s.createDataFrame([(n, *S.last_months(n, e)) for e in _ENDS for n in (0, 1, 4, 13)], "months int, from_day date, to_day date"), f"SELECT n AS months, CAST(e - n * INTERVAL 1 MONTH AS DATE) AS from_day, e AS to_day FROM (VALUES {', '.join(f'(DATE {str(e)!r})' for e in _ENDS)}) t(e), (VALUES (0), (1), (4), (13)) m(n)")

# Sinks
_PULSE = f"pulse AS (SELECT week, median, median_pct_chg, {_round('(median - f) / f * 100', 1)} AS period_pct, median - f AS period_delta, {_round('(median - peak) / peak * 100', 1)} AS from_peak_pct, median - peak AS from_peak_delta, mean_median_ratio FROM l, a)"
_add(
    "pulse_cards", lambda s, d: writers.pulse_cards(market.market_pulse(market.weekly_momentum(_tx(s, d)))),
    TX, FLAT, WEEKS, "a AS (SELECT arg_min(median, week) AS f, max(median) AS peak FROM weeks), l AS (SELECT * FROM weeks ORDER BY week DESC LIMIT 1)", _PULSE,
    "SELECT 'AED ' || format('{:,.0f}', median) AS median, format('{:+.1f}% vs prev wk', median_pct_chg) AS weekly, format('{:+.1f}%', period_pct) AS period, 'AED ' || if(period_delta < 0, '-', '+') || format('{:,.0f}', abs(period_delta)) AS period_delta, "
    "format('{:+.1f}%', from_peak_pct) AS from_peak, 'AED ' || if(from_peak_delta < 0, '-', '+') || format('{:,.0f}', abs(from_peak_delta)) AS from_peak_delta, format('{:.2f}x', mean_median_ratio) AS ratio FROM pulse",
)
_add(
    "kpi_cards", lambda s, d: writers.kpi_cards(market.headline(market.filtered_daily(_tx(s, d), [*fixture.AREA_NAMES], filters.ALL, dt.date(1996, 1, 1), dt.date(1997, 12, 15)))),
    TX, FLAT, DAILY, "sel AS (SELECT * FROM daily WHERE date BETWEEN DATE '1996-01-01' AND DATE '1997-12-15')",
    "k AS (SELECT date, avg(avg_price_aed) AS p, avg(price_per_sqft_aed) AS q, CAST(sum(transaction_count) AS BIGINT) AS n FROM sel GROUP BY date), m AS (SELECT * FROM k ORDER BY date DESC LIMIT 1)",
    f"SELECT 'AED ' || format('{{:,.0f}}', {_round('m.p', 2)}) AS avg_price, 'AED ' || format('{{:,.0f}}', {_round('m.q', 2)}) AS avg_psf, format('{{:,}}', m.n) AS transactions, coalesce(format('{{:+.1f}}%', {_round('(m.p - b.p) / b.p * 100', 1)}), 'N/A') AS yoy, strftime(m.date, '%b %Y') AS as_of "
    "FROM m LEFT JOIN k b ON b.date = CAST(date_trunc('month', m.date - INTERVAL 12 MONTH) AS DATE)",
)


def _folder(s: SparkSession, name: str) -> str:
    """A new folder that all executors reach."""
    return f"{s.conf.get('spark.checkpoint.dir', None) or 'file:///tmp/checkpoints/parcelflow'}/{name}-{uuid.uuid4().hex}"


def _csv(s: SparkSession, d: str) -> DataFrame:
    path = _folder(s, "csv")
    writers.to_csv(market.raw_table(_daily(s, d)).select("date", "neighborhood", "bedroom_type", "transaction_count"), path)
    return files.read(s, path, "csv")


def _table(s: SparkSession, d: str) -> DataFrame:
    path = _folder(s, "table")
    writers.to_table(_tx(s, d).drop("date"), path)
    return files.read(s, path).filter("month = '1996-05'").select("INSTANCE_DATE", "AREA_EN", "TRANS_VALUE")


_add("csv_export", _csv, TX, FLAT, DAILY, SELECTED, "SELECT strftime(date, '%Y-%m-%d') AS date, neighborhood, bedroom_type, transaction_count::VARCHAR AS transaction_count FROM sel")
_add("table_sink", _table, TX, "SELECT strftime(date, '%Y-%m-%d') AS \"INSTANCE_DATE\", area AS \"AREA_EN\", value AS \"TRANS_VALUE\" FROM tx WHERE strftime(date, '%Y-%m') = '1996-05'")

# Sources, over a stand-in of the service that serves the suppliers
_SERVED = """served AS (SELECT s_suppkey AS k, printf('2026-03-%02d 10:%02d:%02d', 1 + s_suppkey % 28, s_suppkey // 60 % 60, s_suppkey % 60) AS t, s_name, s_nationkey,
 CASE WHEN s_suppkey % 4 > 0 THEN 'Sales' ELSE 'Mortgage' END AS grp, CASE WHEN s_suppkey % 5 > 0 THEN 'Flat' ELSE 'Shop' END AS kind, 'AED ' || s_suppkey || ',000.5' AS worth FROM supplier)"""
_services: dict[str, Standin] = {}


def _service(s: SparkSession, d: str) -> Standin:
    if d not in _services:
        _services[d] = Standin(fixture.records(s, d)).start()
    return _services[d]


_FIELDS = ["transaction_id", "instance_date", "actual_worth"]
_SFIELDS = "CAST(k AS VARCHAR) AS transaction_id, t AS instance_date, worth AS actual_worth"
_add("paged_scan", lambda s, d: paged.scan(s, _service(s, d).config, page_size=30, max_records=None).select(_FIELDS), _SERVED, f"SELECT {_SFIELDS} FROM served")
_add("paged_scan_offset", lambda s, d: paged.scan(s, _service(s, d).config, {"order_by": "instance_date", "offset": 7}, page_size=4, max_records=None).limit(30).select(_FIELDS).distinct(), _SERVED, f"SELECT {_SFIELDS} FROM (SELECT * FROM served ORDER BY t LIMIT 30 OFFSET 7)")
_add("paged_scan_capped", lambda s, d: paged.scan(s, _service(s, d).config, paged.query(flat_only=False, newest_first=True), page_size=4, max_records=10).select(_FIELDS), _SERVED, f"SELECT {_SFIELDS} FROM (SELECT * FROM served ORDER BY t DESC LIMIT 10)")
_add("paged_scan_filtered", lambda s, d: paged.scan(s, _service(s, d).config, paged.query(_D(3, 5), _D(3, 20)), page_size=30, max_records=None).filter("instance_date >= '2026-03-07'").select(_FIELDS), _SERVED, f"SELECT {_SFIELDS} FROM served WHERE kind = 'Flat' AND t >= '2026-03-07' AND t <= '2026-03-20'")
_add("paged_scan_ranges", lambda s, d: paged.scan(s, _service(s, d).config, page_size=30, max_records=None, dates=[("2026-03-01", "2026-03-09"), ("2026-03-15", "2026-03-31")]).select(_FIELDS), _SERVED, f"SELECT {_SFIELDS} FROM served WHERE t BETWEEN '2026-03-01' AND '2026-03-09' OR t BETWEEN '2026-03-15' AND '2026-03-31'")
_CANON = ["INSTANCE_DATE", "GROUP_EN", "AREA_EN", "TRANS_VALUE", "ACTUAL_AREA", "ROOMS_EN"]
_SCANON = "substr(t, 1, 10) AS \"INSTANCE_DATE\", grp AS \"GROUP_EN\", upper(s_name) AS \"AREA_EN\", k * 1000 + 0.5::DOUBLE AS \"TRANS_VALUE\", s_nationkey::DOUBLE AS \"ACTUAL_AREA\", (k % 3 + 1)::VARCHAR || ' B/R' AS \"ROOMS_EN\""
_add("snapshot_load", lambda s, d: snapshot.load(s, _service(s, d).config, as_of=_D(3, 25)).transactions.select(_CANON), _SERVED, f"SELECT {_SCANON} FROM served WHERE kind = 'Flat' AND t <= '2026-03-25'")
_add("snapshot_meta", lambda s, d: s.createDataFrame([(lambda x: (*x.window, *x.bounds, json.dumps(x.mapping["ACTUAL_AREA"])))(snapshot.load(s, _service(s, d).config, as_of=_D(3, 25)))], "window_from date, window_to date, first_date date, last_date date, area_columns string"), _SERVED, "SELECT DATE '2025-11-25' AS window_from, DATE '2026-03-25' AS window_to, min(CAST(substr(t, 1, 10) AS DATE)) AS first_date, max(CAST(substr(t, 1, 10) AS DATE)) AS last_date, '[\"actual_area\", \"procedure_area\"]' AS area_columns FROM served WHERE kind = 'Flat' AND t <= '2026-03-25'")
_add("empty_source", lambda s, d: snapshot.transactions(None, s), 'SELECT \'\' AS "INSTANCE_DATE", \'\' AS "GROUP_EN", \'\' AS "IS_OFFPLAN_EN", \'\' AS "AREA_EN", \'\' AS "PROP_SB_TYPE_EN", \'\' AS "PROCEDURE_EN", 0.0::DOUBLE AS "TRANS_VALUE", 0.0::DOUBLE AS "ACTUAL_AREA", \'\' AS "ROOMS_EN" WHERE false')
_add("column_probe", lambda s, d: snapshot.probe(s, _service(s, d).config)[0].select(_CANON), _SERVED, f"SELECT {_SCANON} FROM (SELECT * FROM served ORDER BY t DESC LIMIT 10)")
_add("legacy_scan", lambda s, d: paged.scan_legacy(s, _service(s, d).config, _D(3, 1), _D(3, 31)).select("TRANSACTION_NUMBER", "INSTANCE_DATE", "TRANS_VALUE", "ACTUAL_AREA"), _SERVED, 'SELECT CAST(k AS VARCHAR) AS "TRANSACTION_NUMBER", t AS "INSTANCE_DATE", worth AS "TRANS_VALUE", CAST(s_nationkey AS VARCHAR) AS "ACTUAL_AREA" FROM served WHERE kind = \'Flat\' AND grp = \'Sales\'')
_add("records_to_frame", lambda s, d: files.from_records(s, fixture.records(s, d)).select(*_FIELDS, "note"), _SERVED, f"SELECT {_SFIELDS}, CASE WHEN k % 2 = 1 THEN '[1, \"a\"]' END AS note FROM served")


def _envelopes(s: SparkSession, d: str) -> DataFrame:
    """A file for each nation, in one of five envelopes; non-objects among the records are dropped."""
    path, row = _folder(s, "envelopes"), F.to_json(F.struct("s_suppkey", "s_name"))
    rows = s.read.parquet(f"{d}/supplier.parquet").groupBy("s_nationkey").agg(F.array_join(F.sort_array(F.collect_list(row)), ", ").alias("x"))
    shapes = [("[", "]"), ('{"results": [', "]}"), ('{"result": {"records": [7, ', "]}}"), ('{"data": [', ', "z"]}'), ('{"result": {}, "items": [', "]}")]
    text = F.lit(None)
    for i, (before, after) in enumerate(shapes):
        text = F.when(F.col("s_nationkey") % len(shapes) == i, F.concat(F.lit(before), "x", F.lit(after))).otherwise(text)
    rows.repartitionByRange(25, "s_nationkey").select("s_nationkey", text.alias("value")).write.partitionBy("s_nationkey").text(path)
    return files.read_envelopes(s, path, ["s_suppkey", "s_name"])


_add("envelopes", _envelopes, "SELECT CAST(s_suppkey AS VARCHAR) AS s_suppkey, s_name FROM supplier")
