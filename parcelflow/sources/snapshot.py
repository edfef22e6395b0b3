"""Loading a checked snapshot of transactions from a service."""

from __future__ import annotations

import datetime as dt
from typing import NamedTuple

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

from parcelflow import schema
from parcelflow.functions.scalars import last_months
from parcelflow.operators import normalize
from parcelflow.sources import paged
from parcelflow.sources.config import ServiceConfig, ServiceError

LOOK_BACK_MONTHS = 4


class Snapshot(NamedTuple):
    transactions: DataFrame
    raw_columns: list[str]
    mapping: dict[str, list[str]]
    validation: DataFrame
    params: dict[str, str]
    window: tuple[dt.date, dt.date]
    bounds: tuple[dt.date, dt.date]
    loaded_at: dt.datetime


def load(spark: SparkSession, config: ServiceConfig, start: dt.date | None = None, end: dt.date | None = None, *, page_size: int = paged.PAGE_SIZE, max_records: int | None = paged.MAX_RECORDS, as_of: dt.date | None = None) -> Snapshot:
    """The last months' transactions, normalised, kept and checked; an empty or incomplete answer is an error."""
    config.ensure()
    default = last_months(LOOK_BACK_MONTHS, as_of)
    window = (start or default[0], end or default[1])
    params = paged.query(*window)
    raw = paged.scan(spark, config, params, page_size=page_size, max_records=max_records)
    rows = normalize.normalize(raw).persist(StorageLevel.MEMORY_AND_DISK)  # the service is asked once
    checked = normalize.validate(rows)
    status = checked.collect()  # a row per required column
    if not status[0]["row_count"]:
        rows.unpersist()
        raise ServiceError("the service returned no records")
    if missing := [r["column"] for r in status if r["missing"]]:
        rows.unpersist()
        raise ServiceError("columns are missing or empty: " + ", ".join(missing))
    found = normalize.date_bounds(rows).first()
    bounds = (found["first_date"] or window[0], found["last_date"] or window[1])
    return Snapshot(rows, raw.columns, normalize.resolve_columns(raw.columns), checked, params, window, bounds, dt.datetime.now().replace(microsecond=0))


def picker_bounds(snapshot: Snapshot | None, as_of: dt.date | None = None) -> tuple[dt.date, dt.date]:
    """The loaded range, or else the default window."""
    return snapshot.bounds if snapshot else last_months(LOOK_BACK_MONTHS, as_of)


def transactions(snapshot: Snapshot | None, spark: SparkSession) -> DataFrame:
    return snapshot.transactions if snapshot else schema.empty(spark)


def probe(spark: SparkSession, config: ServiceConfig, records: int = 10) -> tuple[DataFrame, dict[str, list[str]]]:
    """The newest records of any kind, normalised, and which raw columns each canonical one was taken from."""
    params = paged.query(flat_only=False, newest_first=True)
    raw = paged.scan(spark, config, params, page_size=records, max_records=records)
    return normalize.normalize(raw), normalize.resolve_columns(raw.columns)


class Store:
    """Keeps the snapshot for a while, and results by query, arguments and snapshot."""

    def __init__(self, spark: SparkSession, config: ServiceConfig, keep: dt.timedelta = dt.timedelta(hours=1), **options):
        self.spark, self.config, self.keep, self.options = spark, config, keep, options
        self.held: Snapshot | None = None
        self.results: dict = {}

    def snapshot(self) -> Snapshot:
        if self.held is None or dt.datetime.now() - self.held.loaded_at >= self.keep:
            old, self.held = self.held, load(self.spark, self.config, **self.options)
            for df in [*self.results.values(), *([old.transactions] if old else [])]:
                df.unpersist()
            self.results.clear()
        return self.held

    def result(self, query, *args) -> DataFrame:
        """query(transactions, *args), computed once for a snapshot; meant for aggregates."""
        tx = self.snapshot().transactions
        key = (query, args)
        if key not in self.results:
            self.results[key] = query(tx, *args).persist(StorageLevel.MEMORY_AND_DISK)
        return self.results[key]
