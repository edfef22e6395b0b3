"""Raw records from files and from memory; every leaf of JSON stays text."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read(spark: SparkSession, path: str, format: str = "parquet", **options) -> DataFrame:
    """Parquet, JSON lines or CSV. Values of JSON and CSV are read as text, for normalize() to clean."""
    reader = spark.read.options(**options)
    if format == "json":
        return reader.option("primitivesAsString", True).json(path)
    if format == "csv":
        return reader.option("header", True).option("inferSchema", False).csv(path)
    return reader.format(format).load(path)


def _leaf(value) -> str | None:
    return value if value is None or isinstance(value, str) else json.dumps(value)


def read_envelopes(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Records of JSON files that each hold one answer of a service: a list, or an object with records under a usual name.

    A file is parsed whole by the executor that reads it; all values are text. Without `columns` the files are read once
    more, for the names that occur.
    """
    from parcelflow.sources.paged import unwrap

    def rows(batches):
        import pandas as pd

        for batch in batches:
            yield pd.DataFrame({"r": [{k: _leaf(v) for k, v in r.items()} for text in batch["value"] for r in unwrap(json.loads(text))]}, dtype=object)

    records = spark.read.option("wholetext", True).text(path).mapInPandas(rows, "r map<string,string>")
    if columns is None:
        columns = sorted(r[0] for r in records.select(F.explode(F.map_keys("r"))).distinct().collect())  # a row per column
    return records.select(*[F.try_element_at("r", F.lit(c)).alias(c) for c in columns])


def from_records(spark: SparkSession, records: list[dict]) -> DataFrame:
    """Records held by the driver: all keys of all records become text columns, in order of appearance."""
    names = list(dict.fromkeys(k for r in records for k in r))
    kind = T.StructType([T.StructField(n, T.StringType()) for n in names])
    return spark.createDataFrame([tuple(_leaf(r.get(n)) for n in names) for r in records], kind)


# Names that the older loader gives to raw columns.
LEGACY_NAMES = {
    "transaction_id": "TRANSACTION_NUMBER", "instance_date": "INSTANCE_DATE", "trans_group_en": "GROUP_EN", "procedure_name_en": "PROCEDURE_EN",
    "reg_type_en": "IS_OFFPLAN_EN", "property_usage_en": "USAGE_EN", "area_name_en": "AREA_EN", "property_type_en": "PROP_TYPE_EN",
    "property_sub_type_en": "PROP_SB_TYPE_EN", "actual_worth": "TRANS_VALUE", "procedure_area": "ACTUAL_AREA", "rooms_en": "ROOMS_EN",
    "has_parking": "PARKING", "nearest_metro_en": "NEAREST_METRO_EN", "nearest_mall_en": "NEAREST_MALL_EN", "nearest_landmark_en": "NEAREST_LANDMARK_EN",
    "no_of_parties_role_1": "TOTAL_SELLER", "no_of_parties_role_2": "TOTAL_BUYER", "master_project_en": "MASTER_PROJECT_EN",
    "project_name_en": "PROJECT_EN", "meter_sale_price": "METER_SALE_PRICE",
}


def rename_legacy(raw: DataFrame) -> DataFrame:
    """Rename raw columns without cleaning types; the procedure's area stands for the actual one. Only columns that exist."""
    return raw.select(*[F.col(f"`{c}`").alias(LEGACY_NAMES.get(c, c)) for c in raw.columns])
