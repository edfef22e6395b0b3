"""Writing results. Collecting happens only here, for results of bounded size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelflow.functions.scalars import title_case


def to_csv(df: DataFrame, path: str, single: bool = False) -> None:
    """With header and quoting; nulls are empty fields. single: one file, for results that fit one task."""
    (df.coalesce(1) if single else df).write.mode("overwrite").option("header", True).option("emptyValue", '""').csv(path)


def to_table(tx: DataFrame, path: str, mode: str = "append") -> None:
    """The canonical table: Parquet by month, so that ranges of dates prune partitions; a month's rows meet in few files."""
    month = F.substring("INSTANCE_DATE", 1, 7)
    tx.withColumn("month", month).repartition("month", F.pmod(F.xxhash64("AREA_EN", "TRANS_VALUE"), F.lit(16))).write.mode(mode).partitionBy("month").parquet(path)


def kpi_cards(headline: DataFrame) -> DataFrame:
    """Formatted text of headline()."""
    yoy = F.when(F.col("yoy_pct").isNotNull(), F.format_string("%+.1f%%", "yoy_pct")).otherwise("N/A")
    return headline.select(F.concat(F.lit("AED "), F.format_number("avg_price", 0)).alias("avg_price"), F.concat(F.lit("AED "), F.format_number("avg_psf", 0)).alias("avg_psf"), F.format_number("transactions", 0).alias("transactions"), yoy.alias("yoy"), F.date_format("latest_date", "MMM yyyy").alias("as_of"))


def pulse_cards(pulse: DataFrame) -> DataFrame:
    """Formatted text of market_pulse(); a change that doesn't exist is n/a."""
    signed = lambda c, f: F.when(F.col(c).isNotNull(), F.format_string(f, c)).otherwise("n/a")
    return pulse.select(
        F.concat(F.lit("AED "), F.format_number("median", 0)).alias("median"),
        signed("median_pct_chg", "%+.1f%% vs prev wk").alias("weekly"),
        signed("period_pct", "%+.1f%%").alias("period"),
        signed("period_delta", "AED %+,.0f").alias("period_delta"),
        signed("from_peak_pct", "%+.1f%%").alias("from_peak"),
        signed("from_peak_delta", "AED %+,.0f").alias("from_peak_delta"),
        signed("mean_median_ratio", "%.2fx").alias("ratio"),
    )


def area_cards(cheapest: DataFrame) -> DataFrame:
    return cheapest.select(title_case(F.col("area")).alias("area"), F.concat(F.lit("AED "), F.format_number("latest_median_psf", 0), F.lit("/sqft")).alias("price"))


def to_markdown(sections: dict[str, DataFrame], rows: int = 40) -> str:
    """A report as Markdown: the first rows of each section, collected; a section that has more says so."""
    out = []
    for title, df in sections.items():
        out += [f"## {title}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
        shown = df.limit(rows + 1).collect()
        out += ["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in shown[:rows]]
        out += ["", f"Only the first {rows} rows are shown."] * (len(shown) > rows) + [""]
    return "\n".join(out)
