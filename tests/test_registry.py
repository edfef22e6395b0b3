"""The registered queries against their oracles, where the supplied tables are at hand."""

import math
from pathlib import Path

import pytest

from parcelflow.plans import registry

TABLES = Path("/root/testdata/sf0.001")
PICKED = [
    "weekly_momentum", "price_quantiles", "tier_daily_rolling", "strict_dates", "raw_coverage", "column_mapping", "table_shape", "area_membership_long", "range_clamp", "last_months", "pulse_cards", "kpi_cards",
    "csv_export", "table_sink", "paged_scan", "paged_scan_offset", "paged_scan_capped", "paged_scan_filtered", "paged_scan_ranges", "snapshot_load", "snapshot_meta", "empty_source", "column_probe", "legacy_scan",
    "records_to_frame", "envelopes", "normalize_dates", "validate_columns",
]


def plain(value):
    if isinstance(value, float):
        return float(f"{value:.9g}") if math.isfinite(value) else str(value)
    return value


@pytest.mark.skipif(not TABLES.exists(), reason="no supplied tables")
@pytest.mark.parametrize("name", PICKED)
def test_oracle(spark, name):
    duckdb = pytest.importorskip("duckdb").connect()
    for file in TABLES.glob("*.parquet"):
        duckdb.sql(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    df = registry.QUERIES[name](spark, str(TABLES))
    want = duckdb.sql(registry.ORACLES[name])
    assert sorted(want.columns) == sorted(df.columns)
    rows = sorted((tuple(plain(r[c]) for c in want.columns) for r in df.collect()), key=str)
    assert rows == sorted((tuple(map(plain, r)) for r in want.fetchall()), key=str)
