"""A paged JSON service as a Spark data source: format `paged_json`.

Paging ends where a page is short or empty, so one partition reads the pages in turn and yields rows as they come. With
option `dates` (a list of first,last pairs) each range is a partition of its own and ranges are read side by side.
Filters on the service's own columns are pushed into its filter text if spark.sql.python.filterPushdown.enabled is set.
Options: the settings of a service; columns, page_size, max_records, offset, filter, order_by, order_dir, dates, push (whether the session pushes filters).
"""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThanOrEqual, InputPartition, LessThanOrEqual

from parcelflow.sources import http
from parcelflow.sources.config import SETTINGS, ServiceConfig, parse
from parcelflow.sources.files import LEGACY_NAMES, rename_legacy

PAGE_SIZE, MAX_RECORDS = 1000, 100_000
# Raw columns of the service.
COLUMNS = (
    "transaction_id", "instance_date", "trans_group_en", "procedure_name_en", "reg_type_en", "property_usage_en", "area_name_en",
    "property_type_en", "property_sub_type_en", "actual_worth", "actual_area", "procedure_area", "rooms_en", "has_parking", "nearest_metro_en",
    "nearest_mall_en", "nearest_landmark_en", "no_of_parties_role_1", "no_of_parties_role_2", "master_project_en", "project_name_en", "meter_sale_price",
)


def unwrap(payload: Any) -> list[dict]:
    """The records of an answer: a list, or the first list found under the usual names; an inner object counts if it has some."""
    if isinstance(payload, list):
        return [x for x in payload if isinstance(x, dict)]
    if isinstance(payload, dict):
        for key in ("results", "records", "result", "data", "items"):
            inner = payload.get(key)
            if isinstance(inner, list) or isinstance(inner, dict) and unwrap(inner):
                return unwrap(inner)
    return []


def query(start: dt.date | None = None, end: dt.date | None = None, *, flat_only: bool = True, newest_first: bool = False) -> dict[str, str]:
    """Filter and order of a request for transactions."""
    tests = ["property_sub_type_en='Flat'"] * flat_only + [f"instance_date{op}'{day:%Y-%m-%d}'" for op, day in ((">=", start), ("<=", end)) if day]
    return {"order_by": "instance_date", "order_dir": "desc" if newest_first else "asc"} | ({"filter": " AND ".join(tests)} if tests else {})


def pages(config: ServiceConfig, params: dict[str, Any], page_size: int = PAGE_SIZE, max_records: int | None = MAX_RECORDS) -> Iterator[list[dict]]:
    """Pages of records from params' offset on, max_records in all; params' limit is not used."""
    token = http.access_token(config)
    head = {"Authorization": f"Bearer {token}", http.IDENTIFIER: config.security_application_identifier}
    offset, left = int(params.get("offset", 0)), max_records
    fixed = {k: v for k, v in params.items() if k not in ("limit", "offset")}
    while True:
        got = unwrap(http.send(config.data_url, "data request", params={**fixed, "limit": page_size, "offset": offset}, headers=head, verify=config.verify_ssl))
        yield got if left is None else got[:left]
        left = None if left is None else left - len(got)
        if len(got) < page_size or left is not None and left <= 0:
            return
        offset += len(got)


def _text(value: Any) -> str | None:
    return value if value is None or isinstance(value, str) else json.dumps(value)


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str], columns: list[str]):
        self.options, self.columns, self.tests = options, columns, []

    def partitions(self):
        ranges = json.loads(self.options.get("dates", "null"))
        return [InputPartition(r) for r in (ranges or [None])]

    def read(self, partition):
        o = self.options
        config = parse(o)
        params = {k: o[k] for k in ("order_by", "order_dir", "offset") if k in o}
        tests = [*([o["filter"]] if "filter" in o else []), *self.tests]
        if partition.value:
            tests += [f"instance_date>='{partition.value[0]}'", f"instance_date<='{partition.value[1]}'"]
        if tests:
            params["filter"] = " AND ".join(tests)
        most = o.get("max_records", str(MAX_RECORDS))
        for page in pages(config, params, int(o.get("page_size", PAGE_SIZE)), None if most == "none" else int(most)):
            for record in page:
                yield tuple(_text(record.get(c)) for c in self.columns)


class _PushingReader(_Reader):
    """Spark refuses readers that take filters in sessions that don't push any, so this one is for sessions that do."""

    def pushFilters(self, filters):
        signs = {EqualTo: "=", GreaterThanOrEqual: ">=", LessThanOrEqual: "<="}
        for f in filters:
            if type(f) in signs and len(f.attribute) == 1 and f.attribute[0] in self.columns and isinstance(f.value, str) and "'" not in f.value:
                self.tests.append(f"{f.attribute[0]}{signs[type(f)]}'{f.value}'")
            yield f  # Spark tests them again: the service's comparisons may be looser


class PagedJson(DataSource):
    @classmethod
    def name(cls):
        return "paged_json"

    def schema(self):
        return ", ".join(f"`{c}` string" for c in json.loads(self.options.get("columns", json.dumps(COLUMNS))))

    def reader(self, schema):
        kind = _PushingReader if self.options.get("push") == "true" else _Reader
        return kind(dict(self.options), [f.name for f in schema.fields])


def scan(spark: SparkSession, config: ServiceConfig, params: dict[str, Any] | None = None, *, page_size: int = PAGE_SIZE, max_records: int | None = MAX_RECORDS, columns=COLUMNS, dates=None) -> DataFrame:
    """The service's records, all columns as text. max_records holds for each of the date ranges."""
    spark.dataSource.register(PagedJson)
    reader = spark.read.format("paged_json").options(**{s.name: str(getattr(config, s.name)) for s in SETTINGS}).options(**{k: str(v) for k, v in (params or {}).items() if k != "limit"})
    reader = reader.options(page_size=str(page_size), max_records="none" if max_records is None else str(max_records), columns=json.dumps(list(columns)))
    reader = reader.option("push", spark.conf.get("spark.sql.python.filterPushdown.enabled"))
    if dates:
        reader = reader.option("dates", json.dumps([[str(a), str(b)] for a, b in dates]))
    return reader.load()


LEGACY_PAGE_SIZE = 500


def scan_legacy(spark: SparkSession, config: ServiceConfig, start: dt.date | None = None, end: dt.date | None = None, **options) -> DataFrame:
    """The older loader's scan: sales of flats in pages of 500, columns renamed but not cleaned."""
    params = query(start, end)
    params["filter"] = f"{params['filter']} AND trans_group_en='Sales'"
    return rename_legacy(scan(spark, config, params, **({"page_size": LEGACY_PAGE_SIZE, "max_records": None, "columns": tuple(LEGACY_NAMES)} | options)))
