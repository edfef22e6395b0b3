"""Raw records arriving as files: appended to the canonical table, and counted by week as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from parcelflow.functions import scalars as S
from parcelflow.operators import normalize


def raw_stream(spark: SparkSession, path: str, columns: list[str], files_per_trigger: int = 100) -> DataFrame:
    """JSON lines dropped into a folder; all columns as text."""
    kind = ", ".join(f"`{c}` string" for c in columns)
    return spark.readStream.schema(kind).option("maxFilesPerTrigger", files_per_trigger).json(path)


def append_canonical(raw: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Normalise and append as Parquet by month, exactly once; runs until what there is has been read."""
    rows = normalize.normalize(raw)
    rows = rows.withColumn("month", F.substring("INSTANCE_DATE", 1, 7))
    return rows.writeStream.format("parquet").option("path", table).option("checkpointLocation", checkpoint).partitionBy("month").trigger(availableNow=True).start()


def weekly_counts(raw: DataFrame, lateness: str = "14 days") -> DataFrame:
    """week, txns, total by Monday weeks; rows later than the watermark allows are left out. Sums, for a median needs all values."""
    rows = normalize.normalize(raw).withColumn("at", S.day_of(F.col("INSTANCE_DATE")).cast("timestamp")).withWatermark("at", lateness)
    # Windows of seven days start on Thursdays (the epoch's day); four days on is Monday.
    weeks = rows.groupBy(F.window("at", "7 days", startTime="4 days")).agg(F.count("TRANS_VALUE").alias("txns"), F.sum("TRANS_VALUE").alias("total"))
    return weeks.select(F.col("window.start").cast("date").alias("week"), "txns", "total")
