"""Sections of the market report, computed from transactions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parcelflow import schema
from parcelflow.functions import scalars as S
from parcelflow.functions import windows as W
from parcelflow.operators import filters
from parcelflow.operators.distribution import describe
from parcelflow.plans.market import LEAST_TRANSACTIONS, area_change, base


#: Optional column of tenure, and what it says of freehold property.
TENURE, FREEHOLD = "IS_FREE_HOLD_EN", "free hold"


def structure(tx: DataFrame, kind: str = filters.ALL) -> DataFrame:
    """One row: volume, median, mean, their ratio, median price per area, the 10th, 25th and 75th percentiles, and the share and medians of freehold.

    Tenure isn't a canonical column; without one the last three are null. All values are read in one scan.
    """
    price, psf = F.col("TRANS_VALUE"), F.when(F.col("ACTUAL_AREA") > 0, S.divide(F.col("TRANS_VALUE"), F.col("ACTUAL_AREA")))
    free = F.lower(S.strip(F.col(TENURE))) == FREEHOLD if TENURE in tx.columns else F.lit(None).cast("boolean")
    wanted = {"price": price, "psf": psf, "freehold": F.when(free, price), "leasehold": F.when(~free, price)}
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("what"), v.cast("double").alias("x")) for k, v in wanted.items()])).alias("e")
    found = describe(base(tx, kind).select(each).select("e.*"), ["what"], F.col("x"), [0.1, 0.25, 0.5, 0.75])
    one = found.groupBy().agg(*[F.max(F.when(F.col("what") == k, F.struct("n", "mean", "q"))).alias(k) for k in wanted])

    def q(what: str, i: int):
        return S.round_to(F.col(what)["q"][i])

    count = {k: F.coalesce(F.col(k)["n"], F.lit(0)) for k in wanted}
    mean = F.col("price")["mean"]
    share = S.divide(count["freehold"], count["freehold"] + count["leasehold"]) * 100
    return one.select(
        count["price"].cast("long").alias("txns"), q("price", 2).alias("median"), S.round_to(mean).alias("mean"), S.round_to(S.divide(mean, F.col("price")["q"][2]), 2).alias("ratio"), q("psf", 2).alias("median_psf"),
        q("price", 0).alias("p10"), q("price", 1).alias("p25"), q("price", 3).alias("p75"),
        F.when(count["freehold"] + count["leasehold"] > 0, S.round_to(share, 1)).alias("freehold_pct"), q("freehold", 2).alias("freehold_median"), q("leasehold", 2).alias("leasehold_median"),
    )


def concentration(tx: DataFrame, kind: str = filters.ALL, top: int = 10) -> DataFrame:
    """The areas of most transactions with their cumulative share; windows see one row per area."""
    areas = base(tx, kind).filter("AREA_EN is not null").groupBy(F.col("AREA_EN").alias("area")).agg(F.count("TRANS_VALUE").alias("txns"))
    order = Window.orderBy(F.desc("txns"), "area")
    ranked = areas.select("area", "txns", F.row_number().over(order).cast("long").alias("rank"), F.sum("txns").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("c"), F.sum("txns").over(Window.partitionBy()).alias("t"))
    return ranked.filter(F.col("rank") <= top).select("rank", "area", "txns", S.round_to(S.divide(F.col("c"), F.col("t")) * 100, 1).alias("cumulative_pct")).orderBy("rank")


def tier_prices(tx: DataFrame, kind: str = filters.ALL, tiers: DataFrame | None = None) -> DataFrame:
    tiers = schema.tier_dimension(tx.sparkSession) if tiers is None else tiers
    rows = filters.positive_area(base(tx, kind)).join(F.broadcast(tiers), F.col("AREA_EN") == F.col("tier_area"))
    ratio = S.divide(F.col("TRANS_VALUE"), F.col("ACTUAL_AREA"))
    return rows.groupBy("tier_order", "tier").agg(S.round_to(F.median(ratio)).alias("median_psf"), F.count("TRANS_VALUE").alias("txns")).orderBy("tier_order")


def area_moves(tx: DataFrame, kind: str = filters.ALL, bedroom: str = filters.ALL, least: int = LEAST_TRANSACTIONS, falling: bool = True) -> DataFrame:
    """Areas whose weekly median fell (or rose) from first to last week, with the change of price per area."""
    rows = filters.equal_unless_all(base(tx, kind).withColumn("bedroom_type", S.bedroom(F.col("ROOMS_EN"))), "bedroom_type", bedroom)
    psf = F.when(F.col("ACTUAL_AREA") > 0, S.divide(F.col("TRANS_VALUE"), F.col("ACTUAL_AREA")))
    weeks = rows.groupBy(F.col("AREA_EN").alias("area"), S.week_of(F.col("date")).alias("week"))
    weeks = weeks.agg(F.count("TRANS_VALUE").alias("txns"), S.round_to(F.median("TRANS_VALUE")).alias("median"), S.round_to(F.median(psf)).alias("psf"))
    ends = {f"{n}_{c}": f(F.col(c), F.col("week")) for c in ("median", "psf") for n, f in (("first", W.first_by), ("last", W.last_by))}
    areas = weeks.groupBy("area").agg(F.sum("txns").alias("total_txns"), *[x.alias(n) for n, x in ends.items()]).filter((F.col("total_txns") >= least) & F.col("area").isNotNull())
    for c, name in (("median", "pct_change"), ("psf", "psf_pct_change")):
        first, last = F.col(f"first_{c}"), F.col(f"last_{c}")
        areas = areas.withColumn(name, S.round_to(S.divide(last - first, first) * 100, 1))
    moved = areas.filter(F.col("pct_change") < 0 if falling else F.col("pct_change") > 0)
    return moved.orderBy(F.col("pct_change").asc() if falling else F.col("pct_change").desc(), "area")


def volume_shift(weeks: DataFrame, n: int = 3) -> DataFrame:
    """One row: transactions of the last n weeks against the first n."""
    ranked = weeks.filter("week is not null").select("txns", F.row_number().over(Window.orderBy("week")).alias("a"), F.row_number().over(Window.orderBy(F.desc("week"))).alias("z"))
    one = ranked.agg(F.sum(F.when(F.col("a") <= n, F.col("txns"))).alias("first_txns"), F.sum(F.when(F.col("z") <= n, F.col("txns"))).alias("last_txns"))
    return one.withColumn("pct_change", S.round_to(S.divide(F.col("last_txns") - F.col("first_txns"), F.col("first_txns")) * 100, 1))


def skew_shift(weeks: DataFrame) -> DataFrame:
    """One row: mean to median ratio of the first and of the last week."""
    ratio, week = F.col("mean_median_ratio"), F.col("week")
    return weeks.agg(W.first_by(ratio, week).alias("first_ratio"), W.last_by(ratio, week).alias("last_ratio"))


def steepest_declines(tx: DataFrame, kind: str = filters.ALL, n: int = 3, least: int = LEAST_TRANSACTIONS) -> DataFrame:
    return area_change(tx, kind, least).filter("pct_change < 0").orderBy("pct_change", "area").limit(n)


def report(tx: DataFrame, kind: str = filters.ALL) -> dict[str, DataFrame]:
    """All sections by title, in order."""
    from parcelflow.plans.market import momentum, weekly_totals

    weeks = momentum(weekly_totals(tx, kind))
    return {
        "Market structure": structure(tx, kind),
        "Concentration": concentration(tx, kind),
        "Price per area by tier": tier_prices(tx, kind),
        "Weekly momentum": weeks,
        "Falling areas": area_moves(tx, kind),
        "Falling areas, one bedroom": area_moves(tx, kind, bedroom="1BR"),
        "Rising areas": area_moves(tx, kind, falling=False),
        "Volume, last against first weeks": volume_shift(weeks),
        "Skew": skew_shift(weeks),
        "Steepest declines": steepest_declines(tx, kind),
    }
