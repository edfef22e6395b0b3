"""Smoke check of a service: python -m parcelflow.cli --help. Exit 0: usable; 1: not; 2: not configured."""

from __future__ import annotations

import argparse
import dataclasses
import datetime as dt
import sys

from pyspark.sql import SparkSession

from parcelflow.functions.scalars import last_months
from parcelflow.operators import normalize
from parcelflow.sources import config as settings
from parcelflow.sources import paged


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("--start", type=dt.date.fromisoformat)
    p.add_argument("--end", type=dt.date.fromisoformat)
    p.add_argument("--limit", type=int, default=100)
    p.add_argument("--entity")
    p.add_argument("--dataset")
    p.add_argument("--base-url")
    p.add_argument("--secrets", help="TOML file")
    p.add_argument("--prefix", default=settings.PREFIX)
    p.add_argument("--all-types", action="store_true", help="not only flats")
    p.add_argument("--require-records", action="store_true")
    return p.parse_args(argv)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = arguments(argv)
    config = settings.load(path=args.secrets, prefix=args.prefix)
    config = dataclasses.replace(config, **{k: v for k in ("entity", "dataset", "base_url") if (v := getattr(args, k))})
    if config.missing():
        print("not configured: " + ", ".join(config.missing()))
        return 2
    window = (args.start, args.end) if args.start or args.end else last_months()
    most = max(args.limit, 1)
    spark = spark or SparkSession.builder.getOrCreate()
    try:
        params = paged.query(*window, flat_only=not args.all_types, newest_first=True)
        records = [r for page in paged.pages(config, params, min(most, paged.PAGE_SIZE), most) for r in page]
    except settings.ServiceError as e:
        print(e)
        return 1
    print(f"{len(records)} records")
    if not records:
        return int(args.require_records)
    from parcelflow.sources.files import from_records

    raw = from_records(spark, records)
    first, last = normalize.raw_coverage(raw).first()
    print(f"raw dates: {first} to {last}")
    for target, found in normalize.resolve_columns(raw.columns).items():
        print(f"{target}: {', '.join(found) or '-'}")
    missing = [r["column"] for r in normalize.validate(normalize.normalize(raw)).collect() if r["missing"]]
    if missing:
        print("missing or empty: " + ", ".join(missing))
    return int(bool(missing))


if __name__ == "__main__":
    sys.exit(main())
