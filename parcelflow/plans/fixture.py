"""The supplied star-schema tables as raw and as canonical transactions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TIER_NAMES = ("Ultra-premium", "Premium", "Mid-market", "Value", "Budget")
AREA_NAMES = tuple(f"NATION_{i}" for i in range(25))


def transactions(spark: SparkSession, sf_dir: str, area: str = "nation", zero_areas: bool = False) -> DataFrame:
    """Canonical transactions with a typed date: line items with their order, customer's nation and part.

    area: nation, or customer for many small areas. zero_areas: areas one less, so that some are 0.
    """
    table = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    orders = table("orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus", "o_orderpriority")
    if area == "nation":
        nation = table("nation").select("n_nationkey", F.upper("n_name").alias("AREA_EN"))
        areas = table("customer").select("c_custkey", "c_nationkey").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "AREA_EN")
        orders = orders.join(areas, F.col("o_custkey") == F.col("c_custkey"))
    else:
        orders = orders.withColumn("AREA_EN", F.col("o_custkey").cast("string"))
    lines = table("lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_linestatus")
    rows = lines.join(table("part").select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey")).join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    status, priority = F.col("o_orderstatus"), F.substring("o_orderpriority", 1, 1)
    procedure = F.when(priority == "1", "Sale On Payment Plan").when(priority == "2", "Development Registration").when(priority != "5", "Sale")
    return rows.select(
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("INSTANCE_DATE"),
        F.col("o_orderdate").cast("date").alias("date"),
        F.when(status == "F", "Sales").when(status == "O", "Mortgage").otherwise("Other").alias("GROUP_EN"),
        F.when(F.col("l_linestatus") == "O", "Off-Plan").otherwise("Ready").alias("IS_OFFPLAN_EN"),
        "AREA_EN",
        F.when(F.col("p_type") == "ECONOMY", "Flat").otherwise(F.col("p_type")).alias("PROP_SB_TYPE_EN"),
        F.col("l_extendedprice").alias("TRANS_VALUE"),
        (F.col("l_quantity") - (1.0 if zero_areas else 0.0)).alias("ACTUAL_AREA"),
        F.when(F.col("l_linenumber") == 1, "Studio").otherwise(F.concat((F.col("l_linenumber") - 1).cast("string"), F.lit(" B/R"))).alias("ROOMS_EN"),
        procedure.alias("PROCEDURE_EN"),
        F.when(F.col("l_linenumber") == 2, F.lit(None)).when(F.col("l_linenumber") % 2 == 0, "Non Free Hold").otherwise(" Free Hold").alias("IS_FREE_HOLD_EN"),
    )


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as loosely named text columns, for the normalising operators."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_orderdate", "o_orderpriority", "o_orderstatus")
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_linestatus", "l_returnflag")
    n = F.col("l_linenumber")
    day = F.col("o_orderdate")
    text = F.when(n == 1, F.date_format(day, "yyyy-MM-dd HH:mm:ss")).when(n == 2, F.date_format(day, "yyyy-MM-dd'T'HH:mm:ss")).when(n == 3, F.date_format(day, "dd-MM-yyyy"))
    text = text.when(n == 4, F.date_format(day, "dd/MM/yyyy")).when(n == 5, F.lit("not a date")).otherwise(F.concat(F.lit(" "), F.date_format(day, "yyyy-MM-dd"), F.lit("\t")))
    price = F.col("l_extendedprice").cast("decimal(15,2)").cast("string")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("transaction-id"),
        text.alias("Instance Date"),
        F.when(F.col("o_orderstatus") == "F", " Sales ").when(F.col("o_orderstatus") == "O", "Mortgage").alias("trans_group_en"),
        F.when(F.col("l_linestatus") == "O", "Off-Plan").otherwise("Ready\n").alias("reg_type_en"),
        F.concat(F.lit(" area "), F.col("l_returnflag")).alias("area_name_en"),
        F.lit("Flat").alias("property_sub_type_en"),
        F.when(n == 1, F.concat(F.lit("AED "), price)).when(n == 2, F.format_number("l_extendedprice", 2)).when(n == 3, F.concat(price, F.lit("x"))).otherwise(price).alias("actual_worth"),
        F.when(n % 2 == 0, F.col("l_quantity").cast("int").cast("string")).alias("actual_area"),
        F.col("l_quantity").cast("int").cast("string").alias("procedure_area"),
        F.when(n == 1, "STUDIO").when(n == 2, "Office").when(n == 3, "2 B/R").otherwise((n - 1).cast("string")).alias("rooms_en"),
    )


def records(spark: SparkSession, sf_dir: str) -> list[dict]:
    """Suppliers as raw records of a service: what the stand-in serves. A driver holds them, as it holds any service's test records."""
    rows = spark.read.parquet(f"{sf_dir}/supplier.parquet").orderBy("s_suppkey").collect()
    return [
        {
            "transaction_id": r["s_suppkey"], "instance_date": f"2026-03-{1 + r['s_suppkey'] % 28:02d} 10:{r['s_suppkey'] // 60 % 60:02d}:{r['s_suppkey'] % 60:02d}", "trans_group_en": "Sales" if r["s_suppkey"] % 4 else "Mortgage",
            "reg_type_en": "Ready", "area_name_en": f" {r['s_name']}", "property_sub_type_en": "Flat" if r["s_suppkey"] % 5 else "Shop", "actual_worth": f"AED {r['s_suppkey']},000.5",
            "procedure_area": r["s_nationkey"], "rooms_en": str(r["s_suppkey"] % 3 + 1), "note": [1, "a"] if r["s_suppkey"] % 2 else None,
        }
        for r in rows
    ]


def tiers(spark: SparkSession) -> DataFrame:
    """Nations 0 to 19 in five tiers; 20 to 24 in none."""
    rows = [(f"NATION_{i}", TIER_NAMES[i // 4], i // 4) for i in range(20)]
    return spark.createDataFrame(rows, "tier_area string, tier string, tier_order int")
