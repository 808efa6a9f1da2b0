"""Months of a window."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def periods(spark: SparkSession, first: str, last: str) -> DataFrame:
    """(period, n): every month from first to last, numbered from 1."""
    months = spark.range(1).select(F.posexplode(F.sequence(F.to_date(F.lit(f"{first}-01")), F.to_date(F.lit(f"{last}-01")), F.expr("interval 1 month"))).alias("i", "m"))
    return months.select(F.date_format("m", "yyyy-MM").alias("period"), (F.col("i") + 1).cast("long").alias("n"))
