import datetime as dt
import math

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from parcelflow.functions import scalars as S
from parcelflow.functions import windows as W


def column(spark, values, kind, f):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(f(F.col("x"))).collect()]


def test_divide(spark):
    df = spark.createDataFrame([(1.0, 0.0), (-1.0, 0.0), (0.0, 0.0), (None, 0.0), (1.0, None), (6.0, 3.0), (float("nan"), 0.0)], "a double, b double")
    got = [r[0] for r in df.select(S.divide(F.col("a"), F.col("b"))).collect()]
    assert got[0] == math.inf and got[1] == -math.inf and math.isnan(got[2]) and got[3:6] == [None, None, 2.0] and math.isnan(got[6])


@pytest.mark.parametrize("digits,half_even,value,want", [(0, False, 2.5, 3.0), (0, True, 2.5, 2.0), (0, False, -2.5, -3.0), (1, False, 0.25, 0.3), (2, False, 1.005, 1.0), (1, False, None, None)])
def test_round_to(spark, digits, half_even, value, want):
    assert column(spark, [value], "double", lambda x: S.round_to(x, digits, half_even)) == [want]


def test_to_number(spark):
    values = ["AED 1,200.50", " 7 ", "12x", "", "aed 5", None, "12d", "1e3", "-.5", "NaN", "\u00a03\u2003"]
    assert column(spark, values, "string", S.to_number) == [1200.5, 7.0, None, None, None, None, None, 1000.0, -0.5, None, 3.0]


def test_to_day(spark):
    good = ["2026-03-01 10:00:00", "2026-03-01T10:00:00", "2026-03-01", "01-03-2026", "01/03/2026", "2026-03-01T10:00:00Z", " 2026-03-01\t"]
    assert column(spark, good + ["2026-02-30", "", None, "soon"], "string", S.to_day) == [dt.date(2026, 3, 1)] * 7 + [None] * 4


def test_day_of_strictly(spark):
    texts = ["2026-03-01", "2026-03-01 10:00", None, "2026-02-30", "0000-01-01", "01-03-2026"]
    want = [dt.date(2026, 3, 1)] * 2 + [None] * 4
    assert column(spark, texts, "string", S.day_of) == want
    assert column(spark, texts[:3], "string", lambda x: S.day_of(x, strict=True)) == want[:3]
    for bad in texts[3:]:
        with pytest.raises(Exception, match="not a date"):
            column(spark, [bad], "string", lambda x: S.day_of(x, strict=True))


def test_labels(spark):
    assert column(spark, ["STUDIO", "2", "3 B/R", " Office ", None, "٣"], "string", S.room_label) == ["Studio", "2 B/R", "3 B/R", "Office", None, "٣ B/R"]
    assert column(spark, ["2 B/R", "2 B/R B/R", "Studio", None], "string", S.bedroom) == ["2BR", "2BR B/R", "Studio", None]
    assert column(spark, ["AL-BARARI ph 1", "o'neil", None, ""], "string", S.title_case) == ["Al-Barari Ph 1", "O'Neil", None, ""]
    assert column(spark, [-0.1, 0.0, None], "double", S.direction) == ["down", "up", "up"]
    assert column(spark, ["\t Business\u00a0Bay \u2003"], "string", S.strip) == ["Business\u00a0Bay"]


def test_dates(spark):
    days = [dt.date(2026, 3, 31), dt.date(2024, 2, 29), None]
    assert column(spark, days, "date", lambda x: S.months_earlier(x, 1)) == [dt.date(2026, 2, 28), dt.date(2024, 1, 29), None]
    assert column(spark, days, "date", S.same_month_last_year) == [dt.date(2025, 3, 1), dt.date(2023, 2, 1), None]
    assert column(spark, [dt.date(2026, 3, 19), dt.date(2026, 3, 16)], "date", S.week_of) == [dt.date(2026, 3, 16)] * 2
    assert S.same_day_ago(dt.date(2026, 3, 31), 1) == dt.date(2026, 2, 28) and S.same_day_ago(dt.date(2024, 2, 29), 12) == dt.date(2023, 2, 28)
    assert S.last_months(4, dt.date(2026, 3, 19)) == (dt.date(2025, 11, 19), dt.date(2026, 3, 19))
    with pytest.raises(ValueError):
        S.same_day_ago(dt.date(2026, 1, 1), -1)
    with pytest.raises(ValueError):
        S.months_earlier(F.lit(None), -1)


def test_windows(spark):
    df = spark.createDataFrame([(1, 10.0), (2, None), (3, 15.0), (4, 0.0), (5, 1.0)], "k int, x double")
    got = [r[0] for r in df.select("k", W.pct_change(F.col("x"), Window.orderBy("k")).alias("c")).orderBy("k").select("c").collect()]
    assert got == [None, 0.0, 0.5, -1.0, math.inf]
    many = spark.createDataFrame([(i, float(i)) for i in range(1, 15)], "k int, x double")
    got = [r[0] for r in many.select("k", W.rolling_mean(F.col("x"), Window.orderBy("k"), 14).alias("m")).orderBy("k").select("m").collect()]
    assert got == [None] * 13 + [7.5]
    got = [r[0] for r in many.select("k", W.rolling_mean(F.col("x"), Window.orderBy("k"), 14, 3).alias("m")).orderBy("k").select("m").collect()]
    assert got[:3] == [None, None, 2.0]


def test_first_last_by_keep_nulls(spark):
    df = spark.createDataFrame([("a", None, 1.0), ("a", 1, 2.0), ("a", 2, None)], "g string, k int, x double")
    assert df.groupBy("g").agg(W.first_by(F.col("x"), F.col("k")), W.last_by(F.col("x"), F.col("k"))).first()[1:] == (1.0, None)
