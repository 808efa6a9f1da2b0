"""Known changes put into quads, to test that the drift run finds them and nothing else."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aspectdrift.functions.strata import months_apart
from aspectdrift.functions.text import draw_order, uniform
from aspectdrift.sources.scratch import staged


def composition(quads: DataFrame, home: Column, seed: int, *key: str) -> DataFrame:
    """Drops rows so that the home stratum's keep-rate falls from 1 to 0.2 over the periods and the others' rises; edits none."""
    periods = quads.select("period").distinct().withColumn("i", F.dense_rank().over(Window.orderBy("period")) - 1).withColumn("last", F.greatest(F.max("i").over(Window.partitionBy()), F.lit(1)))
    share = F.col("i") / F.col("last")
    keep = F.when(home, 1.0 - 0.8 * share).otherwise(0.2 + 0.8 * share)
    return quads.join(F.broadcast(periods), "period").where(uniform(seed, *map(F.col, key)) < keep).select(*quads.columns)  # one row a month


def valence(quads: DataFrame, code: str, delta: float, start: str, seed: int, *key: str) -> DataFrame:
    """From `start` on turns positive quads of a code negative with probability delta. Shares of complaints move too: negatives count there."""
    hit = (F.col("taxonomy_code") == code) & (F.col("period") >= start) & (F.col("sentiment") == "positive") & (uniform(seed, *map(F.col, key)) < delta)
    return quads.withColumn("sentiment", F.when(hit, "negative").otherwise(F.col("sentiment")))


def shuffle(quads: DataFrame, seed: int) -> DataFrame:
    """Permutes the periods among reviews; all quads of a review move together.

    A permutation needs places over all reviews. They are given within hash buckets that are known beforehand:
    bucket counts, then ranks inside buckets, so no task sorts all reviews. Reviews are written once.
    """
    reviews = staged(quads.groupBy("review_uid").agg(F.min("period").alias("period")))
    source = _placed(reviews, F.md5("review_uid"), "review_uid").select("place", "review_uid")
    target = _placed(reviews, draw_order(seed, F.col("review_uid")), "review_uid").select("place", F.col("period").alias("__period"))
    moved = source.join(target, "place").select("review_uid", "__period")
    return quads.join(moved, "review_uid").withColumn("period", F.col("__period")).select(*quads.columns)


def _placed(rows: DataFrame, order: Column, tie: str) -> DataFrame:
    """Adds place, the row number in `order` (hex digits), by three-digit buckets."""
    rows = rows.withColumn("__o", order).withColumn("__b", F.substring("__o", 1, 3))
    inside = F.row_number().over(Window.partitionBy("__b").orderBy("__o", tie))
    counts = rows.groupBy("__b").count()
    before = counts.select("__b", F.coalesce(F.sum("count").over(Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))  # 4096 rows at most
    return rows.withColumn("__i", inside).join(F.broadcast(before), "__b").withColumn("place", F.col("__i") + F.col("__before")).drop("__o", "__b", "__i", "__before")


def detected(found: Column, start: Column, tolerance: int = 3) -> Column:
    return F.coalesce(months_apart(found, start) <= tolerance, F.lit(False))
