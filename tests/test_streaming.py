import json

from pyspark.sql import functions as F

from parcelflow.streaming import ingest

COLUMNS = ["instance_date", "actual_worth", "area_name_en"]


def test_append_and_weekly(spark, tmp_path):
    (tmp_path / "in").mkdir()
    rows = [{"instance_date": "2026-03-02", "actual_worth": "AED 5"}, {"instance_date": "08-03-2026", "actual_worth": "7"}, {"instance_date": "2026-03-09", "actual_worth": "1"}]
    (tmp_path / "in/a.json").write_text("\n".join(map(json.dumps, rows)))
    raw = ingest.raw_stream(spark, str(tmp_path / "in"), COLUMNS)
    for _ in range(2):  # the second run finds nothing new
        ingest.append_canonical(raw, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).agg(F.sum("TRANS_VALUE")).first()[0] == 13.0
    q = ingest.weekly_counts(raw).writeStream.format("memory").queryName("weeks").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {str(r["week"]): (r["txns"], r["total"]) for r in spark.table("weeks").collect()}
    assert got == {"2026-03-02": (2, 12.0), "2026-03-09": (1, 1.0)}
