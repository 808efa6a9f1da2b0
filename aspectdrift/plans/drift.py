"""The drift run: cells, standardised series, statistics, tests, false-discovery control, verdicts."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from aspectdrift import config
from aspectdrift.functions.strata import length_bin
from aspectdrift.operators import aggregate, inference, series
from aspectdrift.sources.scratch import staged


def recalled(quads: DataFrame, recall: DataFrame) -> DataFrame:
    """quads with weights divided by how often quads of their sentiment and length are found: recall(sentiment, length_bin, rho)."""
    rows = quads.withColumn("__w", aggregate.weight(quads)).withColumn("length_bin", length_bin(F.col("n_words")))
    return rows.join(recall, ["sentiment", "length_bin"], "left").withColumn("w", F.col("__w") / F.coalesce("rho", F.lit(1.0))).drop("__w", "rho", "length_bin")


def channels(cell: DataFrame, prior_share: float = config.PRIOR_SHARE, prior_valence: float = config.PRIOR_VALENCE) -> DataFrame:
    """(aspect, channel, period, value): raw and adj are log-ratios of complaint shares, val_raw and val_adj valences.

    Aspects that only occur outside complaints take part in the log-ratios with share 0.
    """
    aspects = cell.select("aspect").distinct()
    pi = aggregate.shares(aggregate.complaints(cell), aggregate.reference(cell, "complaint").where("wref > 0"), aspects, prior_share)
    pi = aggregate.clr(aggregate.clr(pi, "raw"), "adj")
    nu = aggregate.valences(cell, aggregate.reference(cell, "total"), prior_valence)
    long = lambda rows, raw, adj, names: rows.select("aspect", "period", F.expr(f"stack(2, '{names[0]}', {raw}, '{names[1]}', {adj}) as (channel, value)"))
    return long(pi, "clr_raw", "clr_adj", ("raw", "adj")).unionByName(long(nu, "raw", "adj", ("val_raw", "val_adj"))).select("aspect", "channel", "period", "value")


def drift(
    quads: DataFrame, level: str = "taxonomy_code", cohort: DataFrame | None = None, n_perm: int = config.PERMUTATIONS, n_boot: int = 0,
    prior_share: float = config.PRIOR_SHARE, prior_valence: float = config.PRIOR_VALENCE, alpha: float = config.ALPHA, seed: int = config.SEED,
    recall: DataFrame | None = None, final: bool = False,
) -> DataFrame:
    """One row an aspect and channel: slope, t, split, p-values, q, significant, and the verdicts of the aspect.

    cohort(hotel_id) restricts the hotels; None means all, and a cohort without rows is an error. recall
    (sentiment, length_bin, rho), if given, divides the weights. final refuses to run without recall and with
    permutation counts that can't show a single effect; fewer than twice those are warned about.
    """
    if final and recall is None:
        raise ValueError("a final run needs a recall table")
    if cohort is not None:
        if cohort.isEmpty():
            raise ValueError("the cohort has no hotel")
        quads = quads.join(cohort.select("hotel_id").distinct(), "hotel_id", "left_semi")
    if recall is not None:
        quads = recalled(quads, recall)
    cell = staged(aggregate.cells(quads, level))
    if cell.isEmpty():
        raise ValueError("no quad with a weight and a code of the taxonomy")
    rows = channels(cell, prior_share, prior_valence).withColumn("series_id", F.concat_ws("|", "aspect", "channel"))
    rows = staged(rows.select("aspect", "channel", "series_id", "period", "value"))
    stats = series.statistics(rows).join(inference.permutation_p(rows, n_perm, seed), "series_id")
    name = F.split("series_id", r"\|")
    stats = stats.select(
        name[0].alias("aspect"), name[1].alias("channel"), F.bround("slope_per_year", 4).alias("slope_per_year"), F.bround("t_stat", 2).alias("t_stat"),
        "changepoint", F.bround("split_t", 2).alias("split_t"), F.bround("p_trend", 5).alias("p_perm"), F.bround("p_split", 5).alias("p_perm_changepoint"),
        F.when(name[1].isin("adj", "val_adj"), "adj").otherwise("raw").alias("grid"))
    m = rows.where(F.col("channel").isin("adj", "val_adj") & F.col("value").isNotNull()).groupBy("series_id").count().where(F.col("count") >= series.LEAST_POINTS).count()
    told = inference.diagnostics(m, n_perm, alpha)
    if final and not told["single_effect_reachable"]:
        raise ValueError(f"{n_perm} permutations can't show a single effect among {m} hypotheses")
    if told["margin"] < 2:
        warnings.warn(f"{n_perm} permutations for {m} hypotheses: a single effect needs {told['n_perm_min']}, twice that is safe", stacklevel=2)
    stats = inference.fdr(stats, "p_perm").withColumn("significant", F.col("q") <= alpha).withColumn("q", F.round(F.round("q", 9), 5))
    by = Window.partitionBy("aspect")
    of = lambda c, column: F.max(F.when(F.col("channel") == c, F.col(column))).over(by)
    v = lambda r, a: inference.verdict(of(r, "significant"), of(a, "significant"), of(r, "slope_per_year"), of(a, "slope_per_year"))
    out = stats.withColumn("verdict", v("raw", "adj")).withColumn("verdict_val", v("val_raw", "val_adj"))
    if n_boot:
        slopes = inference.bootstrap_slopes(aggregate.complaint_rows(quads, level), aggregate.reference(cell, "complaint"), cell.select("aspect").distinct(), n_boot, seed, prior_share)
        out = out.join(inference.interval(slopes).select("aspect", F.lit("adj").alias("channel"), F.bround("lo", 4).alias("lo"), F.bround("hi", 4).alias("hi")), ["aspect", "channel"], "left")
    return out.drop("grid").orderBy(F.abs("t_stat").desc(), "aspect", "channel")


def trends(cell: DataFrame, prior_share: float = config.PRIOR_SHARE) -> DataFrame:
    """(aspect, n, slope_per_year, t_stat) of the adjusted complaint share: the drift run without its tests."""
    pi = aggregate.shares(aggregate.complaints(cell), aggregate.reference(cell, "complaint"), cell.select("aspect").distinct(), prior_share)
    rows = aggregate.clr(pi, "adj").select(F.col("aspect").alias("series_id"), "period", F.col("clr_adj").alias("value"))
    return series.trend(series.deseason(series.points(rows))).withColumnRenamed("series_id", "aspect")
