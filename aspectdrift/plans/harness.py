"""Does the drift run find what was put in, and stay silent otherwise? Three tests over injected quads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aspectdrift import config
from aspectdrift.functions.strata import length_bin, months_apart
from aspectdrift.functions.text import uniform
from aspectdrift.operators import inject
from aspectdrift.plans.drift import drift
from aspectdrift.sources.scratch import staged

_ADJ, _RAW = ("adj", "val_adj"), ("raw", "val_raw")


# Terms that make a quad, the share of negative quads, and what a month adds to it for one code.
SMOKE_TERMS = {"AM_FOOD": "breakfast", "FAC_ROOM": "room", "AM_WIFI": "wifi", "SER_ATTITUDE": "staff", "AM_POOL": "pool"}
SMOKE_CODE, SMOKE_BASE, SMOKE_SLOPE = "AM_FOOD", 0.35, 0.012


def smoke_quads(reviews: DataFrame, seed: int = config.SEED, window: tuple[str, str] = config.WINDOW) -> DataFrame:
    """Quads with a known trend out of the negative texts of a store: one for each term that occurs in one, its
    sentiment drawn; only SMOKE_CODE turns more negative month by month."""
    low = F.lower("text_neg")
    found = F.filter(F.array(*[F.struct(F.lit(c).alias("taxonomy_code"), F.contains(low, F.lit(t)).alias("hit")) for c, t in SMOKE_TERMS.items()]), lambda x: x["hit"])
    rows = reviews.where(F.col("period").between(*window)).withColumn("taxonomy_code", F.explode(F.transform(found, lambda x: x["taxonomy_code"])))
    month = months_apart(F.col("period"), F.lit(window[0]))
    chance = F.lit(SMOKE_BASE) + F.when(F.col("taxonomy_code") == SMOKE_CODE, month * SMOKE_SLOPE).otherwise(0.0)
    draw = lambda k: uniform(seed + k, F.col("review_uid"), F.col("taxonomy_code"))
    rows = rows.withColumn("sentiment", F.when(draw(0) < chance, "negative").otherwise("positive"))
    return rows.select(
        "review_uid", "hotel_id", "period", F.concat_ws("|", "country_bloc", "traveller", length_bin(F.col("n_words"))).alias("stratum"), F.when(F.col("sentiment") == "negative", "NEG").otherwise("POS").alias("phi"),
        "taxonomy_code", "sentiment", (0.6 + 0.39 * draw(1)).alias("conf_seq"), F.lit(1.0).alias("w"), "n_words", F.lit(0.9).alias("p_posterior"), F.lit(False).alias("provenance_flip"))


# What a run reads of quads; an injection may read its key as well.
READ = ("review_uid", "hotel_id", "period", "stratum", "taxonomy_code", "category", "reportable", "sentiment", "phi", "w", "conf_seq", "n_words")


def _once(quads: DataFrame, *key: str) -> DataFrame:
    """The columns that runs and injections read, written once for all runs."""
    return staged(quads.select(*[c for c in quads.columns if c in {*READ, *key}]))


def composition_test(quads: DataFrame, home: Column, key: tuple[str, ...], seed: int = config.SEED, **run) -> DataFrame:
    """One row: over shuffled periods with a shifting mix of strata nothing adjusted may be significant.

    FAIL if something is, PASS if a raw series is, INCONCLUSIVE if neither.
    """
    quads = _once(quads.withColumn("__home", home), "__home", *key)
    moved = staged(inject.shuffle(quads, seed))  # its periods are counted before its rows are dropped
    base = inject.composition(moved, F.col("__home"), seed + 1, *key)
    s = drift(base, seed=seed, **run).agg(F.count_if(F.col("significant") & F.col("channel").isin(*_ADJ)).alias("n_adj"), F.count_if(F.col("significant") & F.col("channel").isin(*_RAW)).alias("n_raw"))
    return s.withColumn("outcome", F.when(F.col("n_adj") > 0, "FAIL").when(F.col("n_raw") > 0, "PASS").otherwise("INCONCLUSIVE"))


def valence_sweep(quads: DataFrame, code: str, start: str, key: tuple[str, ...], deltas: tuple[float, ...] = (0.02, 0.05, 0.10, 0.20), seed: int = config.SEED, **run) -> DataFrame:
    """One row a delta: whether the code's valence is found significant with its split within three months of start."""
    if quads.where((F.col("taxonomy_code") == code) & F.col("reportable")).isEmpty():
        raise ValueError(f"{code} is not reported on its own, so it can't be found")
    out, quads = [], _once(quads, *key)
    for i, delta in enumerate(deltas):
        rows = drift(inject.valence(quads, code, delta, start, seed + i, *key), seed=seed, **run).where((F.col("aspect") == code) & F.col("channel").isin(*_ADJ))
        found = F.col("significant") & inject.detected(F.col("changepoint"), F.lit(start))
        by = {r.channel: r for r in rows.select("channel", "significant", found.alias("found"), "changepoint").collect()}
        v, p = by.get("val_adj"), by.get("adj")
        out.append((delta, bool(v and v.significant), bool(v and v.found), v.changepoint if v else None, bool(p and p.found)))
    return quads.sparkSession.createDataFrame(out, "delta double, significant boolean, detected boolean, changepoint string, prevalence_detected boolean")


def shuffle_control(quads: DataFrame, repeats: int = 5, alpha: float = config.ALPHA, seed: int = config.SEED, **run) -> DataFrame:
    """One row: mean share of adjusted tests that are significant on shuffled periods; PASS up to twice alpha."""
    rates, quads = [], _once(quads)
    for r in range(repeats):
        rows = drift(inject.shuffle(quads, seed + r), alpha=alpha, seed=seed + r, **run).where(F.col("channel").isin(*_ADJ))
        rates.append(rows.agg(F.avg(F.col("significant").cast("double"))).first()[0] or 0.0)
    mean = sum(rates) / len(rates)
    return quads.sparkSession.createDataFrame([(repeats, mean, "PASS" if mean <= 2 * alpha else "FAIL")], "repeats int, mean_rate double, outcome string")
