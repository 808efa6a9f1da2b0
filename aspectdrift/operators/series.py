"""Statistics of monthly series in long form: (series_id, period, value), one row a point."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LEAST_POINTS = 12


def points(series: DataFrame, least: int = LEAST_POINTS, calendar_index: bool = False) -> DataFrame:
    """Non-null points of series that have at least `least`, with their place x from 0 and count n.

    x counts points; with calendar_index it counts months from the first point, so gaps are kept.
    """
    by = Window.partitionBy("series_id")
    rows = series.where("value IS NOT NULL").withColumn("n", F.count("*").over(by)).where(F.col("n") >= least)
    month = F.substring("period", 1, 4).cast("int") * 12 + F.substring("period", 6, 2).cast("int")
    x = month - F.min(month).over(by) if calendar_index else F.row_number().over(by.orderBy("period")) - 1
    return rows.withColumn("x", x)


def deseason(rows: DataFrame) -> DataFrame:
    """Adds y: the value less its month's mean, plus the series' mean."""
    month = Window.partitionBy("series_id", F.substring("period", 6, 2))
    return rows.withColumn("y", F.col("value") - (F.avg("value").over(month) - F.avg("value").over(Window.partitionBy("series_id"))))


def trend(rows: DataFrame) -> DataFrame:
    """(series_id, n, slope_per_year, t_stat) of y on x; an exact fit and a single point have t 0."""
    by = Window.partitionBy("series_id")
    c = rows.select("series_id", (F.col("x") - F.avg("x").over(by)).alias("dx"), (F.col("y") - F.avg("y").over(by)).alias("dy"))
    c = c.withColumn("b", F.sum(F.col("dx") * F.col("dy")).over(by) / F.nullif(F.sum(F.col("dx") * F.col("dx")).over(by), F.lit(0.0)))
    rest = F.col("dy") - F.col("b") * F.col("dx")
    s = c.groupBy("series_id").agg(F.count("*").alias("n"), F.max("b").alias("b"), F.sum(rest * rest).alias("ssr"), F.sum(F.col("dx") * F.col("dx")).alias("sxx"))
    se = F.when((F.col("n") > 2) & (F.col("sxx") > 0), F.sqrt(F.col("ssr") / F.nullif(F.col("n") - 2, F.lit(0)) / F.nullif(F.col("sxx"), F.lit(0.0))))
    return s.select("series_id", "n", F.coalesce(F.col("b") * 12, F.lit(0.0)).alias("slope_per_year"), F.coalesce(F.col("b") / F.nullif(se, F.lit(0.0)), F.lit(0.0)).alias("t_stat"))


def best_split(rows: DataFrame) -> DataFrame:
    """(series_id, split, split_t, changepoint): the place with the largest |Welch t|, the first of equals.

    The left side has 4 points or more, the right side 5. Without a split of t above 0 the place is -1.
    """
    by = Window.partitionBy("series_id")
    before = by.orderBy("x").rowsBetween(Window.unboundedPreceding, -1)
    c = rows.withColumn("i", F.row_number().over(by.orderBy("x")) - 1).withColumn("v", F.col("y") - F.avg("y").over(by))
    sq = F.col("v") * F.col("v")
    c = c.select("series_id", "period", "x", "i", "n", "v", F.sum("v").over(before).alias("sl"), F.sum(sq).over(before).alias("ql"), F.sum("v").over(by).alias("s"), F.sum(sq).over(by).alias("q"))
    na, nb = F.col("i"), F.col("n") - F.col("i")
    sr, qr = F.col("s") - F.col("sl"), F.col("q") - F.col("ql")
    spread = lambda q, s, n: F.greatest(q - s * s / n, F.lit(0.0)) / (n - 1)
    den = F.sqrt(spread(F.col("ql"), F.col("sl"), na) / na + spread(qr, sr, nb) / nb)
    inner = (F.col("i") >= 4) & (F.col("i") < F.col("n") - 4)
    t = F.when(inner, F.abs(F.col("sl") / F.nullif(na, F.lit(0)) - sr / F.nullif(nb, F.lit(0))) / F.nullif(F.when(inner, den), F.lit(0.0)))
    best = c.withColumn("t", t).groupBy("series_id").agg(F.max(F.when(t > 0, F.struct(t.alias("t"), (-F.col("i")).alias("i"), F.col("period").alias("p")))).alias("m"))
    return best.select("series_id", F.coalesce(-F.col("m.i"), F.lit(-1)).cast("int").alias("split"), F.coalesce("m.t", F.lit(0.0)).alias("split_t"), F.col("m.p").alias("changepoint"))


def statistics(series: DataFrame, least: int = LEAST_POINTS, calendar_index: bool = False) -> DataFrame:
    """Trend and split of every series with enough points."""
    rows = deseason(points(series, least, calendar_index).repartition("series_id"))
    return trend(rows).join(best_split(rows), "series_id")


def seasonal_amplitude(series: DataFrame) -> DataFrame:
    """(series_id, amplitude): population deviation of the months' means."""
    months = series.where("value IS NOT NULL").groupBy("series_id", F.substring("period", 6, 2).alias("m")).agg(F.avg("value").alias("mean"))
    return months.groupBy("series_id").agg(F.stddev_pop("mean").alias("amplitude"))
