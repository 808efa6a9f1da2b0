"""Choosing pseudo-labels, guarding their mix of sentiments, and the teacher-student loop."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aspectdrift.operators.codec import PROMPT, linearize
from aspectdrift.operators.sampling import reservoir


def pseudo_rows(quads: DataFrame, tau: float = 0.7, tau_post: float = 0.8, most: int | None = None, empty_ratio: float = 0.0, seed: int = 0) -> DataFrame:
    """(review_uid, phi, text, quads, n_quads, target): units with passing quads, and some with none as empty targets.

    quads(review_uid, phi, text, conf_seq, p_posterior, aspect_term, taxonomy_code, opinion_term, sentiment, ord).
    """
    ok = (F.col("conf_seq") >= tau) & (F.col("p_posterior") >= tau_post)
    one = F.struct("ord", "aspect_term", "taxonomy_code", "opinion_term", "sentiment")
    units = quads.groupBy("review_uid", "phi").agg(F.min("text").alias("text"), F.sort_array(F.collect_list(F.when(ok, one))).alias("quads"))
    units = units.withColumn("n_quads", F.size("quads")).withColumn("target", linearize(F.col("quads")))
    full = units.where("n_quads > 0")
    full = reservoir(full, most, seed, "review_uid", "phi") if most is not None else full
    if empty_ratio <= 0:
        return full
    return full.unionByName(reservoir(units.where("n_quads = 0"), int(empty_ratio * full.count()), seed + 1, "review_uid", "phi"))


def negative_rate(units: DataFrame) -> DataFrame:
    """(n, rate) of negative quads among all quads of units(quads)."""
    rows = units.select(F.explode("quads").alias("q"))
    return rows.agg(F.count("*").alias("n"), F.avg((F.col("q.sentiment") == "negative").cast("double")).alias("rate"))


def skewed(gold: DataFrame, pseudo: DataFrame, most: float = 0.15) -> DataFrame:
    """(n, rate, gold_rate, stop): whether the pseudo-labels' share of negatives is too far from gold's, or there are none."""
    p, g = negative_rate(pseudo), negative_rate(gold).select(F.col("rate").alias("gold_rate"))
    return p.crossJoin(g).withColumn("stop", F.coalesce((F.col("n") == 0) | (F.abs(F.col("rate") - F.col("gold_rate")) > most), F.lit(True)))  # one row each


def training_set(gold: DataFrame, pseudo: DataFrame | None) -> DataFrame:
    """(input, target, n_quads, origin): gold rows and pseudo-labelled units as one bag, nothing deduplicated."""
    rows = gold.select("input", "target", "n_quads", F.lit("gold").alias("origin"))
    if pseudo is None:
        return rows
    return rows.unionByName(pseudo.select(F.concat(F.lit(PROMPT), "text").alias("input"), "target", "n_quads", F.lit("pseudo").alias("origin")))


def loop(gold: DataFrame, extract: Callable, train: Callable, evaluate: Callable, rounds: int = 3, max_skew: float = 0.15, max_ratio: float = 1.0, seed: int = 0) -> list[dict]:
    """Rounds of extract -> choose -> train -> evaluate; a round counts only if the score rises.

    extract(model, seed) -> quads; train(gold, pseudo) -> model; evaluate(model) -> score. gold(quads). Returns
    the history; the last accepted entry names the model to use.
    """
    model = train(gold, None)
    best, n_gold = evaluate(model), gold.count()
    history = [{"round": 0, "score": best, "accepted": True, "model": model, "stop": None}]
    for k in range(1, rounds + 1):
        pseudo = pseudo_rows(extract(model, seed + k), most=int(max_ratio * n_gold), seed=seed + k)
        got = skewed(gold, pseudo, max_skew).first()
        if got.stop:
            history.append({"round": k, "score": None, "accepted": False, "model": None, "stop": "skew" if got.n else "nothing passed"})
            break
        new = train(gold, pseudo)
        score = evaluate(new)
        history.append({"round": k, "score": score, "accepted": score > best, "model": new, "stop": None if score > best else "no gain"})
        if score <= best:
            break
        model, best = new, score
    return history
