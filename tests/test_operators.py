import datetime as dt

from pyspark.sql import functions as F

from parcelflow import schema
from parcelflow.operators import filters, normalize


def test_resolve_columns():
    found = normalize.resolve_columns(["Instance Date", "instance-date", "procedure_area", "actual_area", "x"])
    assert found["INSTANCE_DATE"] == ["Instance Date", "instance-date"]
    assert found["ACTUAL_AREA"] == ["actual_area", "procedure_area"] and found["PROCEDURE_AREA"] == ["procedure_area"] and found["ROOMS_EN"] == []


def test_normalize(spark):
    raw = [
        {"instance_date": "01/03/2026", "INSTANCE_DATE": None, "area_name_en": " Business Bay\t", "actual_worth": "AED 1,200.50", "rooms_en": "studio", "procedure_area": 80, "trans_group_en": "Sales "},
        {"instance_date": "bad", "actual_worth": 5, "actual_area": "7", "procedure_area": "9", "rooms_en": "2", "new": [1]},
    ]
    got = normalize.normalize_records(spark, raw)
    a, b = got.collect()
    assert (a["INSTANCE_DATE"], a["AREA_EN"], a["TRANS_VALUE"], a["ROOMS_EN"], a["ACTUAL_AREA"], a["GROUP_EN"]) == ("2026-03-01", "BUSINESS BAY", 1200.5, "Studio", 80.0, "Sales")
    assert (b["INSTANCE_DATE"], b["TRANS_VALUE"], b["ACTUAL_AREA"], b["PROCEDURE_AREA"], b["ROOMS_EN"], b["USAGE_EN"]) == (None, 5.0, 7.0, 9.0, "2 B/R", None)
    assert "PROP_SB_TYPE_EN" not in got.columns and set(schema.OPTIONAL) <= set(got.columns)
    assert dict(got.dtypes)["METER_SALE_PRICE"] == "double"
    assert normalize.normalize_records(spark, []).columns == list(schema.MINIMUM)


def test_normalize_mixed_types_and_raw(spark):
    raw = spark.createDataFrame([(None, 2.5, "a.b")], "actual_worth string, TRANS_VALUE double, `x.y` string")
    row = normalize.normalize(raw, keep_raw=True).first()
    assert row["TRANS_VALUE"] == 2.5 and row["raw"]["x.y"] == "a.b"


def test_validate_and_bounds(spark):
    df = normalize.normalize_records(spark, [{"instance_date": "2026-03-02"}, {"instance_date": None}, {"instance_date": "2026-01-05"}])
    rows = {r["column"]: r for r in normalize.validate(df).collect()}
    assert set(rows) == set(schema.REQUIRED) and rows["INSTANCE_DATE"]["non_null"] == 2 and not rows["INSTANCE_DATE"]["missing"]
    assert rows["AREA_EN"]["missing"] and not rows["AREA_EN"]["present"] and rows["AREA_EN"]["row_count"] == 3
    assert normalize.date_bounds(df).first()[:] == (dt.date(2026, 1, 5), dt.date(2026, 3, 2))
    assert normalize.date_bounds(schema.empty(spark)).first()[:] == (None, None)
    assert normalize.date_bounds(df.drop("INSTANCE_DATE")).first()[:] == (None, None)
    raw = spark.createDataFrame([("2026-03-02T1",), ("",), (None,)], "instance_date string")
    assert normalize.raw_coverage(raw).first()[:] == ("2026-03-02", "2026-03-02")
    assert normalize.raw_coverage(raw.toDF("other")).first()[:] == (None, None)


def test_transaction_types(spark):
    rows = [(1, "Sales", "Off-Plan", None), (2, "MORTGAGE", None, "Sale On Payment Plan"), (3, None, None, None), (4, "sales", "Ready", "Development x")]
    df = spark.createDataFrame(rows, "i int, GROUP_EN string, IS_OFFPLAN_EN string, PROCEDURE_EN string")
    ids = lambda d: sorted(r["i"] for r in d.collect())
    assert ids(filters.transaction_type(df, "Sale")) == [1, 4] and ids(filters.transaction_type(df, "Mortgage")) == [2]
    assert ids(filters.transaction_type(df, "Off-Plan")) == [1, 2, 4] and ids(filters.transaction_type(df, "whatever")) == [1, 2, 3, 4]
    assert ids(filters.transaction_type(df.drop("PROCEDURE_EN"), "Off-Plan")) == [1]
    assert ids(filters.transaction_type(df.drop("PROCEDURE_EN", "IS_OFFPLAN_EN"), "Off-Plan")) == []


def test_selection(spark):
    d = dt.date
    df = spark.createDataFrame([("a", "1BR", d(2026, 1, 1)), ("b", "2BR", d(2026, 1, 2)), ("a", None, d(2026, 1, 3))], "neighborhood string, bedroom_type string, date date")
    assert filters.selected(df, ["a"], "All", d(2026, 1, 1), d(2026, 1, 3)).count() == 2
    assert filters.selected(df, ["a"], "1BR", d(2026, 1, 1), d(2026, 1, 3)).count() == 1
    assert filters.members(df, "neighborhood", [f"x{i}" for i in range(600)] + ["b"]).count() == 1
    assert filters.at_latest(df).count() == 1 and filters.at_latest(df.filter("false")).count() == 0
    assert filters.clamp(d(2025, 1, 1), d(2027, 1, 1), d(2026, 1, 1), d(2026, 2, 1)) == (d(2026, 1, 1), d(2026, 2, 1))
    assert filters.clamp(d(2027, 1, 1), d(2027, 2, 1), d(2026, 1, 1), d(2026, 2, 1)) == (d(2026, 1, 1), d(2026, 2, 1))
    assert filters.clamp(d(2026, 1, 5), d(2026, 1, 6), d(2026, 1, 1), d(2026, 2, 1)) == (d(2026, 1, 5), d(2026, 1, 6))


def test_key_filters_reach_the_scan(spark, tmp_path):
    from parcelflow.plans import market

    path = str(tmp_path / "tx")
    spark.createDataFrame([(d, "Flat", "A", 1.0, 2.0, "1 B/R") for d in (dt.date(2026, 1, 1), dt.date(2026, 1, 9))], "date date, PROP_SB_TYPE_EN string, AREA_EN string, TRANS_VALUE double, ACTUAL_AREA double, ROOMS_EN string").write.parquet(path)
    got = market.filtered_daily(spark.read.parquet(path), ["A"], "All", dt.date(2026, 1, 5), dt.date(2026, 1, 10))
    plan = spark._jvm.PythonSQLUtils.explainString(got._jdf.queryExecution(), "formatted")
    pushed = next(x for x in plan.splitlines() if x.startswith("PushedFilters"))
    assert "GreaterThanOrEqual(date," in pushed and "EqualTo(AREA_EN,A)" in pushed and got.count() == 1
    assert "Python" not in plan


def test_describe(spark):
    import numpy as np

    from parcelflow.operators.distribution import describe

    rng = np.random.default_rng(1)
    rows = [(k, float(v) if v < 18 else None) for k in ("a", "b", None) for v in rng.integers(0, 20, 101 if k == "a" else 50)] + [("only null", None)]
    df = spark.createDataFrame(rows, "k string, x double")
    for r in describe(df, ["k"], F.col("x"), [0.0, 0.1, 0.5, 0.75, 1.0]).collect():
        own = [x for k, x in rows if k == r["k"] and x is not None]
        assert r["n"] == len(own)
        if own:
            assert np.allclose(r["q"], np.quantile(own, [0, 0.1, 0.5, 0.75, 1])) and abs(r["mean"] - np.mean(own)) < 1e-9
        else:
            assert r["mean"] is None and r["q"] is None
    assert describe(df, [], F.col("x"), [0.5]).first()["n"] == sum(x is not None for _, x in rows)
    assert describe(df.filter("false"), ["k"], F.col("x"), [0.5]).count() == 0
