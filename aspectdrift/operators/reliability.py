"""Weights of quads: propensity, the bridge from images to text, its gate, and its application."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aspectdrift import config
from aspectdrift.operators import evaluate, sampling
from aspectdrift.sources.scratch import staged

FEATURES = ("conf_seq", "p_posterior", "phi_pos", "log_len", "prov_flip")
# What a model must reach to be used.
LEAST_AUC, LEAST_GAIN, LEAST_RHO, LEAST_PAIRS = 0.70, 0.05, 0.30, 30


def bridge_features(q=F.col) -> list[Column]:
    """One definition for fitting and applying, in the order of FEATURES."""
    return [q("conf_seq").cast("double"), q("p_posterior").cast("double"), (q("phi") == "POS").cast("double"), F.log1p(q("n_words").cast("double")), q("provenance_flip").cast("double")]


def propensity_features(q=F.col) -> list[Column]:
    """A score of 0 is a score; only null takes the default."""
    return [F.log1p(q("n_words").cast("double")), F.coalesce(q("score").cast("double"), F.lit(config.DEFAULT_SCORE))]


def logistic(features: list[Column], weights: list[float], intercept: float) -> Column:
    z = sum((f * float(w) for f, w in zip(features, weights, strict=True)), F.lit(float(intercept)))
    return 1 / (1 + F.exp(-z))


def fit_logistic(rows: DataFrame, features: list[str], label: str, weight: str | None = None, rounds: int = 50) -> tuple[list[float], float]:
    """Minimise the weighted sum of losses plus half the squared coefficients. One class only is an error.

    Newton steps: each is one aggregation of gradient and curvature, a few dozen sums, whatever the number of
    rows; a step that doesn't lower the loss is halved.
    """
    k = len(features)
    data = staged(rows.select(*[F.col(f).cast("double").alias(f"f{i}") for i, f in enumerate(features)], F.col(label).cast("double").alias("y"), (F.col(weight) if weight else F.lit(1.0)).cast("double").alias("w")))
    if data.agg(F.count_distinct(F.when(F.col("w") > 0, F.col("y")))).first()[0] < 2:
        raise ValueError("the labels have one class only")
    x = [F.col(f"f{i}") for i in range(k)] + [F.lit(1.0)]
    penalty = np.append(np.ones(k), 0.0)

    def sums(theta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        z = sum((f * float(t) for f, t in zip(x, theta, strict=True)), F.lit(0.0))
        at = data.select("*", z.alias("z")).withColumn("p", 1 / (1 + F.exp(-F.col("z"))))
        loss = F.col("w") * (F.greatest(F.col("z"), F.lit(0.0)) - F.col("y") * F.col("z") + F.log1p(F.exp(-F.abs("z"))))
        slope, bend = F.col("w") * (F.col("p") - F.col("y")), F.col("w") * F.col("p") * (1 - F.col("p"))
        pairs = [(i, j) for i in range(k + 1) for j in range(i + 1)]
        got = at.agg(F.sum(loss), *[F.sum(slope * f) for f in x], *[F.sum(bend * x[i] * x[j]) for i, j in pairs]).first()
        h = np.diag(penalty)
        for (i, j), v in zip(pairs, got[k + 2 :], strict=True):
            h[i, j] += v
            h[j, i] = h[i, j]
        return got[0] + 0.5 * (penalty * theta * theta).sum(), np.array(got[1 : k + 2]) + penalty * theta, h

    theta = np.zeros(k + 1)
    loss, g, h = sums(theta)
    for _ in range(rounds):
        step = np.linalg.solve(h + np.eye(k + 1) * 1e-12, g)
        while True:
            new = sums(theta - step)
            if new[0] <= loss + 1e-9 * abs(loss) or np.abs(step).max() < 1e-9:
                break
            step = step / 2
        theta, (loss, g, h) = theta - step, new
        if np.abs(step).max() < 1e-9:
            break
    return theta[:-1].tolist(), float(theta[-1])


def ipw(rows: DataFrame, label: str = "has_photo") -> DataFrame:
    """Adds ipw: one over the propensity of having a photo, clipped to .02 and 1."""
    one, two = propensity_features()
    data = rows.withColumn("__f0", one).withColumn("__f1", two)
    w, b = fit_logistic(data, ["__f0", "__f1"], label)
    return data.withColumn("ipw", 1 / F.least(F.greatest(logistic([F.col("__f0"), F.col("__f1")], w, b), F.lit(0.02)), F.lit(1.0))).drop("__f0", "__f1")


def soft_labelled(rows: DataFrame, target: str = "v_image", weight: str | None = "ipw") -> DataFrame:
    """Every row twice: label 1 weighted by its target, label 0 by the rest."""
    w = F.col(weight) if weight else F.lit(1.0)
    return rows.withColumn("y", F.lit(1)).withColumn("w_fit", F.col(target) * w).unionByName(rows.withColumn("y", F.lit(0)).withColumn("w_fit", (1 - F.col(target)) * w))


def fit_bridge(rows: DataFrame, target: str = "v_image", weight: str | None = "ipw") -> tuple[list[float], float]:
    data = soft_labelled(rows, target, weight)
    for name, column in zip(FEATURES, bridge_features(), strict=True):
        data = data.withColumn(f"__{name}", column)
    return fit_logistic(data, [f"__{n}" for n in FEATURES], "y", "w_fit")


def verdict(auc: float | None, gain: float | None, rho: float | None, pairs: int) -> str:
    ok = passes(auc, gain) and pairs >= LEAST_PAIRS and rho is not None and rho >= LEAST_RHO
    return "GO" if ok else "NO-GO"


def passes(auc: float | None, gain: float | None) -> bool:
    """Whether a verifier tells pairs apart, and better than categories alone do."""
    return auc is not None and auc >= LEAST_AUC and gain is not None and gain >= LEAST_GAIN


def audited(quads: DataFrame, audit: DataFrame, order: str) -> DataFrame:
    """quads(quad_uid) with the human mark of audit(quad_uid, correct): the last one in `order`; null marks don't count."""
    last = audit.where("correct IS NOT NULL").groupBy(F.col("quad_uid").alias("__u")).agg(F.max_by("correct", order).alias("correct"))
    return quads.join(last, F.col("quad_uid") == F.col("__u")).drop("__u")


def bridge_gate(quads: DataFrame, audit: DataFrame, model: tuple[list[float], float], order: str) -> DataFrame:
    """(n, rho, verdict): the bridge's weights against the audit of the same quads."""
    scored = audited(quads, audit, order).select(logistic(bridge_features(), *model).alias("r"), F.col("correct").cast("double").alias("correct"))
    return evaluate.gate(scored, "r", "correct", LEAST_PAIRS, LEAST_RHO)


# ---------------------------------------------------------------- images against categories


def review_of(quad_id: Column) -> Column:
    """A quad's review: its name before the last _Q."""
    return F.regexp_replace(quad_id, r"(?s)^(.*)_Q.*$", "$1")


def verifier_pairs(images: DataFrame, quads: DataFrame, splits: DataFrame, categories: DataFrame, seed: int) -> DataFrame:
    """(image, review, category, y, split): an image with the categories of its review, and as many others.

    images(review, image), quads(quad_id, category), splits(review, split), categories(category); reviews without a split train.
    """
    of = quads.select(review_of(F.col("quad_id")).alias("review"), "category").distinct()
    positives = staged(images.select("review", "image").distinct().join(of, "review"))  # owners, categories and rows read it
    owner = positives.select("review", "image").distinct()
    wrong = sampling.negatives(positives.select("image", "category"), categories, positives.select("image", "category"), "image", seed).join(owner, "image")
    rows = positives.withColumn("y", F.lit(1)).unionByName(wrong.withColumn("y", F.lit(0)))
    side = splits.groupBy("review").agg(F.max("split").alias("split"))
    return rows.join(side, "review", "left").select("image", "review", "category", "y", F.coalesce("split", F.lit("train")).alias("split"))


def fit_verifier(pairs: DataFrame, categories: list[str]) -> tuple[list[float], float, dict, DataFrame]:
    """(coefficients, intercept, report, area by category) of a head over sim and the category's mark.

    pairs(sim, category, y, split): train and dev fit, test measures. The baseline knows the category alone; a slice with
    one class has no area.
    """
    marks = [f"c{i}" for i in range(len(categories))]
    rows = pairs.withColumns({m: (F.col("category") == c).cast("double") for m, c in zip(marks, categories, strict=True)})
    fits, test = rows.where(F.col("split").isin("train", "dev")), rows.where("split = 'test'")
    weights, bias = fit_logistic(fits, ["sim", *marks], "y")
    base, base_bias = fit_logistic(fits, marks, "y")
    scored = test.withColumn("score", logistic([F.col(c) for c in ("sim", *marks)], weights, bias)).withColumn("plain", logistic([F.col(c) for c in marks], base, base_bias))
    area = {c: evaluate.auc(scored, c, "y").first().auc if not scored.isEmpty() else None for c in ("score", "plain")}
    gain = area["score"] - area["plain"] if None not in area.values() else None
    report = {"auc": area["score"], "baseline": area["plain"], "gain": gain, "verdict": "GO" if passes(area["score"], gain) else "NO-GO"}
    return weights, bias, report, evaluate.auc(test, "sim", "y", "category")


def apply_weights(quads: DataFrame, in_taxonomy: Column, model: tuple[list[float], float] | None = None) -> DataFrame:
    """Adds w, 0 outside the taxonomy, and w_source. Without a model that may be used, w is conf_seq."""
    if model is not None and len(model[0]) != len(FEATURES):
        raise ValueError(f"the model has {len(model[0])} features, not {len(FEATURES)}")
    r = logistic(bridge_features(), *model) if model else F.col("conf_seq")
    w = F.when(F.coalesce(in_taxonomy, F.lit(False)), F.bround(r, 4)).otherwise(0.0)
    return quads.withColumn("w", w).withColumn("w_source", F.lit("bridge" if model else "conf_seq"))


def attach_images(quads: DataFrame, images: DataFrame) -> DataFrame:
    """quads with v_image and reason (scored, no_image, no_score) from images(review_uid, v_image), one row a review."""
    out = quads.join(images.withColumn("__has", F.lit(True)), "review_uid", "left")
    return out.withColumn("reason", F.when(F.col("__has").isNull(), "no_image").when(F.col("v_image").isNull(), "no_score").otherwise("scored")).drop("__has")


def is_image(content: Column) -> Column:
    """At least 12 bytes that begin as JPEG, PNG, GIF, BMP or WebP."""
    head = F.hex(F.substring(content, 1, 12))
    start = lambda s: head.startswith(s)
    webp = start("52494646") & (F.substring(head, 17, 8) == "57454250")
    return (F.octet_length(content) >= 12) & (start("FFD8FF") | start("89504E470D0A1A0A") | start("474946383761") | start("474946383961") | start("424D") | webp)
