"""Sentiment scores of a model combined with where the text stood."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aspectdrift import config

S = config.SENTIMENTS


def softmax(logp: dict[str, Column]) -> Column:
    """struct of probabilities from log-probabilities; if they hardly differ the model said nothing: see degenerate()."""
    top = F.greatest(*logp.values())
    total = sum((F.exp(v - top) for v in logp.values()), F.lit(0.0))
    return F.struct(*[(F.exp(logp[s] - top) / total).alias(s) for s in S])


def degenerate(logp: dict[str, Column]) -> Column:
    return F.greatest(*logp.values()) - F.least(*logp.values()) < 1e-6


def variants(logp: dict[str, Column], generated: Column) -> Column:
    """The softmax, or .9 for the generated sentiment and .05 for the others where the scores are degenerate."""
    fixed = F.struct(*[F.when(generated == s, 0.9).otherwise(0.05).alias(s) for s in S])
    return F.when(degenerate(logp), fixed).otherwise(softmax(logp))


def provenance(p: dict[str, Column], phi: Column, lam: float = config.PROVENANCE_LAMBDA) -> Column:
    """struct(sentiment, posterior): softmax of lam ln p + (1 - lam) ln prior; of equals the first of positive, neutral, negative."""
    prior = {s: F.when(phi == "POS", config.PROVENANCE_PRIOR["POS"][i]).when(phi == "NEG", config.PROVENANCE_PRIOR["NEG"][i]) for i, s in enumerate(S)}
    logs = {s: lam * F.ln(F.greatest(F.coalesce(p[s], F.lit(1e-9)), F.lit(1e-9))) + (1 - lam) * F.ln(prior[s]) for s in S}
    top = F.greatest(*logs.values())
    total = sum((F.exp(v - top) for v in logs.values()), F.lit(0.0))
    best = F.array_max(F.array(*[F.struct(logs[s].alias("v"), F.lit(-i).alias("o"), F.lit(s).alias("s")) for i, s in enumerate(S)]))
    return F.struct(best["s"].alias("sentiment"), (F.exp(best["v"] - top) / total).alias("posterior"))


def enriched(quads: DataFrame, logp: dict[str, Column] | None = None, lam: float = config.PROVENANCE_LAMBDA) -> DataFrame:
    """quads(sentiment, phi, mean_logp) with all that a model's scores say about them.

    Without scores, or where they hardly differ, the generated sentiment has .9; flags tell both apart. The sentiment
    becomes the likeliest one given where the text stood.
    """
    said = F.col("sentiment")
    flat = degenerate(logp) if logp else F.lit(False)
    p = variants(logp, said) if logp else F.struct(*[F.when(said == s, 0.9).otherwise(0.05).alias(s) for s in S])
    rows = quads.withColumn("p_model", p).withColumn("p_model_exact", F.lit(logp is not None) & ~flat).withColumn("p_model_truncated", flat)
    rows = rows.withColumn("__out", provenance({s: F.col(f"p_model.{s}") for s in S}, F.col("phi"), lam)).withColumn("sentiment_model", said)
    rows = rows.withColumn("p_model", F.struct(*[F.bround(f"p_model.{s}", 4).alias(s) for s in S])).withColumn("conf_seq", F.bround(confidence(F.col("mean_logp")), 4))
    rows = rows.withColumn("sentiment", F.col("__out.sentiment")).withColumn("p_posterior", F.bround("__out.posterior", 4))
    return rows.withColumn("provenance_flip", F.col("sentiment") != F.col("sentiment_model")).drop("__out")


def confidence(mean_logp: Column) -> Column:
    return F.exp(mean_logp)


def cosine(a: Column, b: Column) -> Column:
    """Of two arrays of numbers; null where either is zero."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda u, v: u.cast("double") * v), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))
