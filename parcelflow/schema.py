"""The canonical transaction table: columns, types, the names they go by in raw records, and the area tiers."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


class Canonical(NamedTuple):
    name: str
    type: str
    required: bool
    aliases: tuple[str, ...]


# Canonical columns with the raw names that stand for them, in order of priority.
COLUMNS = (
    Canonical("INSTANCE_DATE", "string", True, ("INSTANCE_DATE", "instance_date", "transaction_date", "procedure_date")),
    Canonical("GROUP_EN", "string", True, ("GROUP_EN", "trans_group_en", "transaction_group_en")),
    Canonical("IS_OFFPLAN_EN", "string", True, ("IS_OFFPLAN_EN", "reg_type_en", "is_offplan_en", "property_status_en")),
    Canonical("AREA_EN", "string", True, ("AREA_EN", "area_name_en", "area_en", "area_name")),
    Canonical("PROP_SB_TYPE_EN", "string", True, ("PROP_SB_TYPE_EN", "property_sub_type_en", "property_subtype_en", "prop_sb_type_en")),
    Canonical("TRANS_VALUE", "double", True, ("TRANS_VALUE", "actual_worth", "transaction_value", "trans_value", "procedure_value")),
    Canonical("ACTUAL_AREA", "double", True, ("ACTUAL_AREA", "actual_area", "procedure_area", "property_area", "area")),
    Canonical("ROOMS_EN", "string", True, ("ROOMS_EN", "rooms_en", "rooms", "rooms_name_en")),
    Canonical("TRANSACTION_NUMBER", "string", False, ("TRANSACTION_NUMBER", "transaction_id", "transaction_number", "transaction_no")),
    Canonical("PROCEDURE_EN", "string", False, ("PROCEDURE_EN", "procedure_name_en", "procedure_en")),
    Canonical("USAGE_EN", "string", False, ("USAGE_EN", "property_usage_en", "usage_en")),
    Canonical("PROP_TYPE_EN", "string", False, ("PROP_TYPE_EN", "property_type_en", "prop_type_en")),
    Canonical("PROCEDURE_AREA", "double", False, ("PROCEDURE_AREA", "procedure_area")),
    Canonical("PARKING", "string", False, ("PARKING", "has_parking", "parking")),
    Canonical("NEAREST_METRO_EN", "string", False, ("NEAREST_METRO_EN", "nearest_metro_en")),
    Canonical("NEAREST_MALL_EN", "string", False, ("NEAREST_MALL_EN", "nearest_mall_en")),
    Canonical("NEAREST_LANDMARK_EN", "string", False, ("NEAREST_LANDMARK_EN", "nearest_landmark_en")),
    Canonical("TOTAL_BUYER", "double", False, ("TOTAL_BUYER", "no_of_parties_role_2", "total_buyer")),
    Canonical("TOTAL_SELLER", "double", False, ("TOTAL_SELLER", "no_of_parties_role_1", "total_seller")),
    Canonical("MASTER_PROJECT_EN", "string", False, ("MASTER_PROJECT_EN", "master_project_en")),
    Canonical("PROJECT_EN", "string", False, ("PROJECT_EN", "project_name_en", "project_en")),
    Canonical("METER_SALE_PRICE", "double", False, ("METER_SALE_PRICE", "meter_sale_price")),
)
REQUIRED = tuple(c.name for c in COLUMNS if c.required)
OPTIONAL = tuple(c.name for c in COLUMNS if not c.required)
#: Text columns that are stripped; the area is upper-cased as well.
STRIPPED = ("GROUP_EN", "IS_OFFPLAN_EN", "AREA_EN", "PROP_SB_TYPE_EN", "PROCEDURE_EN", "USAGE_EN", "PROP_TYPE_EN")
#: The least that an empty snapshot has.
MINIMUM = ("INSTANCE_DATE", "GROUP_EN", "IS_OFFPLAN_EN", "AREA_EN", "PROP_SB_TYPE_EN", "PROCEDURE_EN", "TRANS_VALUE", "ACTUAL_AREA", "ROOMS_EN")

# Selectable areas in display order.
AREAS = (
    "JUMEIRAH VILLAGE CIRCLE", "BUSINESS BAY", "MAJAN", "DUBAI MARINA", "BURJ KHALIFA", "JUMEIRAH LAKES TOWERS", "DUBAI CREEK HARBOUR",
    "ARJAN", "DUBAI SPORTS CITY", "SILICON OASIS", "INTERNATIONAL CITY PH 1", "MEYDAN ONE", "DISCOVERY GARDENS", "AL FURJAN",
    "SOBHA HEARTLAND", "PALM JUMEIRAH", "DUBAI HILLS", "THE GREENS", "DUBAI PRODUCTION CITY", "MOTOR CITY",
)

# Price tiers in order, with their areas.
TIERS = {
    "Ultra-premium": ("BLUEWATERS", "DUBAI HARBOUR", "DUBAI WATER CANAL"),
    "Premium": ("PALM JUMEIRAH", "BURJ KHALIFA", "DUBAI CREEK HARBOUR", "DUBAI HILLS", "MEYDAN ONE", "JUMEIRAH BEACH RESIDENCE", "AL BARARI"),
    "Mid-market": (
        "DUBAI MARINA", "BUSINESS BAY", "JUMEIRAH LAKES TOWERS", "SOBHA HEARTLAND", "THE GREENS", "AL FURJAN",
        "DUBAI HEALTHCARE CITY - PHASE 2", "DAMAC HILLS", "JUMEIRAH VILLAGE TRIANGLE", "TOWN SQUARE", "AL YELAYISS 2",
    ),
    "Value": ("JUMEIRAH VILLAGE CIRCLE", "ARJAN", "MOTOR CITY", "DISCOVERY GARDENS", "SILICON OASIS", "DUBAI PRODUCTION CITY", "DUBAI SOUTH"),
    "Budget": ("INTERNATIONAL CITY PH 1", "DUBAI LAND RESIDENCE COMPLEX", "LIWAN", "DUBAI SPORTS CITY", "MAJAN", "DUBAI INVESTMENT PARK SECOND"),
}


def empty(spark: SparkSession) -> DataFrame:
    """The empty snapshot."""
    kinds = {c.name: c.type for c in COLUMNS}
    return spark.createDataFrame([], ", ".join(f"{c} {kinds[c]}" for c in MINIMUM))


def tier_dimension(spark: SparkSession, tiers: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """area, tier, tier_order: one row per area, upper-cased; a few dozen rows by construction."""
    rows = {a.upper(): (t, i) for i, (t, areas) in enumerate((tiers or TIERS).items()) for a in areas}
    kind = T.StructType([T.StructField("tier_area", T.StringType()), T.StructField("tier", T.StringType()), T.StructField("tier_order", T.IntegerType())])
    return spark.createDataFrame([(a, *x) for a, x in rows.items()], kind)
