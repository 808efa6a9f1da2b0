"""Further looks at drift: distances between compositions, opinion centroids, sequential detectors, spans, injections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aspectdrift.functions.strata import length_bin
from aspectdrift.functions.text import norm_text, uniform
from aspectdrift.operators.posterior import cosine


def divergence(shares: DataFrame, column: str = "adj") -> DataFrame:
    """(period, js): Jensen-Shannon divergence, in nats, of each period's shares (period, aspect, column) from the period before."""
    w = Window.partitionBy("aspect").orderBy("period")
    rows = shares.withColumn("p", F.col(column)).withColumn("q", F.lag(column).over(w)).where("q IS NOT NULL")
    half = lambda a: F.when(F.col(a) > 0, F.col(a) * F.ln(2 * F.col(a) / (F.col("p") + F.col("q")))).otherwise(0.0) / 2
    return rows.groupBy("period").agg(F.sum(half("p") + half("q")).alias("js"))


def signature(share_moves: Column, valence_moves: Column) -> Column:
    """What kind of drift an aspect shows: both, salience, sentiment or none."""
    a, b = F.coalesce(share_moves, F.lit(False)), F.coalesce(valence_moves, F.lit(False))
    return F.when(a & b, "both").when(a, "salience").when(b, "sentiment").otherwise("none")


def centroids(vectors: DataFrame, *by: str, weight: str | None = None) -> DataFrame:
    """(by..., centre): weighted mean vector of each group; one partial sum a dimension leaves a task."""
    w = F.col(weight) if weight else F.lit(1.0)
    parts = vectors.select(*by, w.alias("__w"), F.posexplode("vector").alias("i", "x")).groupBy(*by, "i").agg((F.sum(F.col("x").cast("double") * F.col("__w")) / F.sum("__w")).alias("m"))
    return parts.groupBy(*by).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "m"))), lambda p: p["m"]).alias("centre"))


def opinion_drift(vectors: DataFrame, aspect: str = "aspect", period: str = "period") -> DataFrame:
    """(aspect, period, drift): one minus the cosine of each period's opinion centroid and the one before."""
    c = centroids(vectors, aspect, period)
    before = F.lag("centre").over(Window.partitionBy(aspect).orderBy(period))
    return c.withColumn("__b", before).where("__b IS NOT NULL").select(aspect, period, (1 - cosine(F.col("centre"), F.col("__b"))).alias("drift"))


def detectors(series: DataFrame, delta: float = 0.005, alpha: float = 0.2) -> DataFrame:
    """(series_id, n, cusum, cusum_at, page_hinkley, ewma) of series(series_id, period, value).

    cusum: the largest distance of the cumulated deviations from the mean and where it is; page_hinkley: how far the
    cumulated deviations from the running mean, less delta a step, rise above their least value; ewma: the last
    exponentially weighted mean, less the mean, in standard deviations of the series.
    """
    by = Window.partitionBy("series_id")
    upto = by.orderBy("period").rowsBetween(Window.unboundedPreceding, 0)
    rows = series.where("value IS NOT NULL").withColumn("m", F.avg("value").over(by)).withColumn("k", F.row_number().over(by.orderBy("period"))).withColumn("n", F.count("*").over(by))
    rows = rows.withColumn("s", F.sum(F.col("value") - F.col("m")).over(upto)).withColumn("step", F.col("value") - F.avg("value").over(upto) - delta)
    rows = rows.withColumn("h", F.sum("step").over(upto))
    rows = rows.withColumn("rise", F.col("h") - F.least(F.min("h").over(upto), F.lit(0.0)))
    age = F.col("n") - F.col("k")
    share = F.when(F.col("k") == 1, F.pow(F.lit(1 - alpha), age)).otherwise(alpha * F.pow(F.lit(1 - alpha), age))
    return rows.groupBy("series_id").agg(
        F.count("*").alias("n"), F.max(F.abs("s")).alias("cusum"), F.max(F.struct(F.round(F.abs("s"), 9), F.col("period"))).getField("period").alias("cusum_at"), F.max("rise").alias("page_hinkley"),
        ((F.sum(share * F.col("value")) - F.max("m")) / F.nullif(F.stddev_pop("value"), F.lit(0.0))).alias("ewma"))


def agreement(rows: DataFrame, a: str, b: str, *by: str) -> DataFrame:
    """(by..., n, r): correlation of two series point by point."""
    both = rows.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    return both.groupBy(*by).agg(F.count("*").alias("n"), F.corr(a, b).alias("r"))


def span_valid(term: Column, text: Column, forms: bool = True) -> Column:
    """Whether a term stands in its text, apart from case, signs and blanks; an unnamed term does."""
    return term.isNull() | F.contains(F.concat(F.lit(" "), norm_text(text, forms), F.lit(" ")), F.concat(F.lit(" "), norm_text(term, forms), F.lit(" ")))


def inject_prevalence(quads: DataFrame, code: str, keep: float, start: str, seed: int, *key: str) -> DataFrame:
    """From `start` on keeps a code's complaints with probability keep, so its share falls while its valence hardly moves."""
    hit = (F.col("taxonomy_code") == code) & (F.col("period") >= start) & ((F.col("phi") == "NEG") | (F.col("sentiment") == "negative"))
    return quads.where(~hit | (uniform(seed, *map(F.col, key)) < keep))


def inject_length(quads: DataFrame, bin_: str, keep: float, start: str, seed: int, *key: str) -> DataFrame:
    """From `start` on keeps texts of one length bin with probability keep."""
    hit = (length_bin(F.col("n_words")) == bin_) & (F.col("period") >= start)
    return quads.where(~hit | (uniform(seed, *map(F.col, key)) < keep))


def inject_opinion(quads: DataFrame, code: str, term: str, rate: float, start: str, seed: int, *key: str) -> DataFrame:
    """From `start` on replaces a code's opinion terms with probability rate; neither shares nor valences move."""
    hit = (F.col("taxonomy_code") == code) & (F.col("period") >= start) & (uniform(seed, *map(F.col, key)) < rate)
    return quads.withColumn("opinion_term", F.when(hit, term).otherwise(F.col("opinion_term")))
