"""Precision and recall of bags of quads, overall and by slice; rank statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aspectdrift.sources.scratch import staged


def bag_counts(gold: DataFrame, predicted: DataFrame, *keys: str) -> DataFrame:
    """(keys..., gold, pred, hits): sizes of both bags and of their intersection, by equal keys; null keys equal nothing.

    Both bags are counted in one aggregation. Most keys occur once, so rows move first: no task counts in a table as long as its
    input, only in one as long as its part of the shuffle.
    """
    apart = F.when(reduce(Column.__or__, [F.col(k).isNull() for k in keys]), F.col("__gold"))
    side = lambda rows, n: rows.select(*keys, F.lit(n).alias("__gold"))
    rows = side(gold, 1).unionByName(side(predicted, 0)).withColumn("__apart", apart).repartition(*keys, "__apart")
    rows = rows.groupBy(*keys, "__apart").agg(F.count_if(F.col("__gold") == 1).alias("gold"), F.count_if(F.col("__gold") == 0).alias("pred"))
    return rows.drop("__apart").withColumn("hits", F.least("gold", "pred"))


def prf(rows: DataFrame, *by: str) -> DataFrame:
    """Precision, recall and F1 of bag counts, four digits, 0 where undefined."""
    s = rows.groupBy(*by).agg(*[F.sum(c).alias(c) for c in ("gold", "pred", "hits")])
    ratio = lambda a, b: F.coalesce(F.col(a) / F.nullif(F.col(b), F.lit(0)), F.lit(0.0))
    p, r = ratio("hits", "pred"), ratio("hits", "gold")
    f1 = F.coalesce(2 * p * r / F.nullif(p + r, F.lit(0.0)), F.lit(0.0))
    return s.select(*by, "gold", "pred", "hits", F.bround(p, 4).alias("precision"), F.bround(r, 4).alias("recall"), F.bround(f1, 4).alias("f1"))


def sliced(gold: DataFrame, predicted: DataFrame, instances: DataFrame) -> DataFrame:
    """PRF by (slice, value): overall, language, length and polarity by instance, category and sentiment by quad.

    gold and predicted: (instance_id, key, sentiment, category); instances: (instance_id, language, length).
    Instance slices explode each instance's values once; counts are summed once for all slices.
    """
    counts = bag_counts(gold, predicted, "instance_id", "key", "sentiment", "category")
    polar = gold.groupBy("instance_id").agg(F.collect_set("sentiment").alias("polarities"))
    of = instances.join(polar, "instance_id", "left")
    pair = lambda s, v: F.struct(F.lit(s).alias("slice"), v.cast("string").alias("value"))
    values = F.concat(
        F.array(pair("overall", F.lit("all")), pair("language", F.col("language")), pair("length", F.col("length")), pair("category", F.col("category")), pair("polarity_quad", F.col("sentiment"))),
        F.transform(F.coalesce("polarities", F.array().cast("array<string>")), lambda s: pair("polarity", s)))
    rows = counts.join(of, "instance_id").select("gold", "pred", "hits", F.inline(values))
    return prf(rows, "slice", "value")


def language_bucket(language: Column) -> Column:
    return F.when(language.isin("en", "vi"), language).otherwise("other")


def covers(report: DataFrame, slice_name: str) -> DataFrame:
    """(covers): whether the slice's gold quads add up to all gold quads."""
    total = lambda s: F.sum(F.when(F.col("slice") == s, F.col("gold")))
    return report.agg((total(slice_name) == total("overall")).alias("covers"))


def totals_below(rows: DataFrame, value: str, amounts: list[str], *by: str, buckets: int = 64) -> DataFrame:
    """Adds below_<amount>: its sum over rows of the same `by` with a smaller value. One row a (by, value).

    Values are dealt to buckets by about equal quantiles, summed inside each, and buckets add up what lies before
    them, so no task sorts all values of a hot slice.
    """
    rows = staged(rows)  # three passes read it
    splits = sorted(set(rows.stat.approxQuantile(value, [k / buckets for k in range(1, buckets)], 0.002)))  # `buckets` numbers
    own = F.size(F.filter(F.array(*map(F.lit, splits)), lambda s: s <= F.col(value))) if splits else F.lit(0)
    rows = rows.withColumn("__b", own)
    sums = rows.groupBy(*by, "__b").agg(*[F.sum(a).alias(f"__{a}") for a in amounts])
    earlier = Window.partitionBy(*by).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)  # `buckets` rows a slice
    before = sums.select(*by, "__b", *[F.coalesce(F.sum(f"__{a}").over(earlier), F.lit(0)).alias(f"__{a}") for a in amounts])
    inside = Window.partitionBy(*by, "__b").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({f"below_{a}": F.coalesce(F.sum(a).over(inside), F.lit(0)) for a in amounts}).join(before, [*by, "__b"])
    return rows.withColumns({f"below_{a}": F.col(f"below_{a}") + F.col(f"__{a}") for a in amounts}).drop("__b", *[f"__{a}" for a in amounts])


def mean_ranks(rows: DataFrame, column: str) -> DataFrame:
    """(column, rank) of each distinct value: rank from 1 with ties at their mean."""
    ranked = totals_below(rows.groupBy(column).agg(F.count("*").alias("n")), column, ["n"])
    return ranked.select(column, (F.col("below_n") + (F.col("n") + 1) / 2.0).alias("rank"))


def spearman(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """(n, rho) of numeric pairs without nulls."""
    rows = pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b"))
    rows = staged(rows)  # the ranks of both and the pairs themselves read it
    ranked = rows.join(mean_ranks(rows, "a").withColumnRenamed("rank", "ra"), "a").join(mean_ranks(rows, "b").withColumnRenamed("rank", "rb"), "b")
    return ranked.agg(F.count("*").alias("n"), F.corr("ra", "rb").alias("rho"))


def auc(rows: DataFrame, score: str, label: str, *by: str) -> DataFrame:
    """(by..., n, auc): area under the curve by rank sums, exact; null where a slice has one class only."""
    c = rows.groupBy(*by, F.col(score).cast("double").alias("__s")).agg(F.sum(F.col(label).cast("long")).alias("p"), F.count("*").alias("n")).withColumn("q", F.col("n") - F.col("p"))
    c = totals_below(c, "__s", ["q"], *by)
    s = c.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("p").alias("p"), F.sum(F.col("p") * (F.col("below_q") + F.col("q") / 2.0)).alias("u"))
    pairs = F.col("p").cast("double") * (F.col("n") - F.col("p"))
    return s.select(*by, "n", (F.col("u") / F.nullif(pairs, F.lit(0.0))).alias("auc"))


def gate(pairs: DataFrame, a: str, b: str, least_pairs: int, least_rho: float) -> DataFrame:
    """(n, rho, verdict): GO with enough pairs and rank correlation, NO-GO otherwise."""
    s = spearman(pairs, a, b)
    return s.withColumn("verdict", F.when((F.col("n") >= least_pairs) & (F.coalesce("rho", F.lit(-1.0)) >= least_rho), "GO").otherwise("NO-GO"))
