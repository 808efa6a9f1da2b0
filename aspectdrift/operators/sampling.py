"""Samples in the order of a hash: uniform, the same on every run and partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aspectdrift.functions.strata import conf_band, length_bin
from aspectdrift.functions.text import draw_order
from aspectdrift.sources.scratch import staged


def reservoir(rows: DataFrame, n: int, seed: int, *key: str) -> DataFrame:
    """n rows, each as likely; a top-n by hash, so every task keeps n rows at most."""
    return rows.orderBy(draw_order(seed, *map(F.col, key)), *key).limit(n)


def per_cell(rows: DataFrame, cells: list[str], k: int | Column, seed: int, *key: str) -> DataFrame:
    """The first k rows of each cell in hash order; the rank filter is pushed below the shuffle as a group limit."""
    rank = F.row_number().over(Window.partitionBy(*cells).orderBy(draw_order(seed, *map(F.col, key)), *key))
    return rows.withColumn("__rank", rank).where(F.col("__rank") <= k).drop("__rank")


def stratified(rows: DataFrame, cells: list[str], n: int, seed: int, *key: str, cap: int = 10**9) -> DataFrame:
    """About n rows, the same number from each cell (at least one, at most cap), cut at n in hash order.

    rows are worked out once: min(cap, n) of each cell are written, and show how many cells there are.
    """
    rows = staged(per_cell(rows, cells, min(cap, max(1, n)), seed, *key))
    count = max(rows.select(*cells).distinct().count(), 1)
    return reservoir(per_cell(rows, cells, min(cap, max(1, n // count)), seed, *key), n, seed + 1, *key)


def review_sample(reviews: DataFrame, n: int, seed: int) -> DataFrame:
    """About n reviews to be annotated in full, alike from each length and with or without a negative text.

    reviews(review_uid, period, n_words, text_pos, text_neg, in_gold, has_text); gold reviews take no part.
    """
    rows = reviews.where(~F.col("in_gold") & F.col("has_text")).withColumn("length_bin", length_bin(F.col("n_words"))).withColumn("has_neg", F.coalesce(F.col("text_neg") != "", F.lit(False)))
    return stratified(rows, ["length_bin", "has_neg"], n, seed, "review_uid", cap=200).select("review_uid", "period", "length_bin", "has_neg", "text_pos", "text_neg")


def quad_sample(quads: DataFrame, n: int, seed: int) -> DataFrame:
    """About n quads to be marked right or wrong, alike from each confidence band, side and flip; its draws are its own."""
    rows = quads.withColumn("conf_band", conf_band(F.col("conf_seq")))
    return stratified(rows, ["conf_band", "phi", "provenance_flip"], n, seed + 1, "quad_uid", cap=300)


def negatives(positives: DataFrame, categories: DataFrame, excluded: DataFrame, item: str, seed: int) -> DataFrame:
    """For every item as many categories it doesn't have as it has positives, or all there are.

    positives and excluded: (item, category). The cross join is with the few categories of the taxonomy.
    """
    n = positives.groupBy(item).agg(F.count_distinct("category").alias("n_pos"))
    pool = n.crossJoin(categories.select("category").distinct()).join(excluded.select(item, "category").distinct(), [item, "category"], "left_anti")
    return per_cell(pool, [item], F.col("n_pos"), seed, item, "category").select(item, "category")
