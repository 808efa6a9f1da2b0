"""Aspects by word lists: mining terms from gold quads, finding them in texts, and the probe's own shares."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aspectdrift.functions.text import nfc, word_count

_EDGE = r"[\p{L}\p{N}_]"


def mine(quads: DataFrame, least: int = 3, share: float = 0.6, forms: bool = True) -> DataFrame:
    """(term, code, n, share): terms of 3 or more characters and at most 3 words whose commonest code has the share."""
    term = F.lower(nfc(F.col("aspect_term"), forms))
    rows = quads.select(term.alias("term"), F.col("taxonomy_code").alias("code")).where((F.length("term") >= 3) & (word_count(F.col("term")) <= 3))
    counts = rows.groupBy("term", "code").agg(F.count("*").alias("n"))
    best = counts.groupBy("term").agg(F.max(F.struct("n", "code")).alias("b"), F.sum("n").alias("total"))
    out = best.select("term", F.col("b.code").alias("code"), F.col("b.n").alias("n"), (F.col("b.n") / F.col("total")).alias("share"))
    return out.where((F.col("n") >= least) & (F.col("share") >= share))


def pattern(terms: list[str]) -> str:
    """Whole terms, longest first."""
    return f"(?<!{_EDGE})(?:{'|'.join(re.escape(t) for t in sorted(terms, key=lambda t: (-len(t), t)))})(?!{_EDGE})"


def hits(rows: DataFrame, text: Column, lexicon: dict[str, list[str]], forms: bool = True) -> DataFrame:
    """One row a (row, code) with a hit, code added; every text is searched once a code, inside the JVM."""
    low = F.lower(nfc(text, forms))
    found = F.array_compact(F.array(*[F.when(low.rlike(pattern(terms)), F.lit(code)) for code, terms in sorted(lexicon.items())]))
    return rows.withColumn("code", F.explode(found))


def extract(units: DataFrame, lexicon: dict[str, list[str]], forms: bool = True) -> DataFrame:
    """Quads without a model: one for each code with a term in the text, the first term found, in order of codes.

    units(phi, text, ...) keep their columns; a positive text makes positive quads, a negative one negative ones; no opinion
    is named and the confidence is 1 (mean_logp 0).
    """
    low = F.lower(nfc(F.col("text"), forms))
    one = lambda code, terms: F.struct(F.lit(code).alias("taxonomy_code"), F.nullif(F.regexp_extract(low, f"({pattern(terms)})", 1), F.lit("")).alias("aspect_term"))
    found = F.filter(F.array(*[one(c, t) for c, t in sorted(lexicon.items())]), lambda q: q["aspect_term"].isNotNull())
    rows = units.select(*units.columns, F.posexplode(found).alias("ord", "__q")).select(*units.columns, "ord", "__q.*")
    return rows.withColumn("opinion_term", F.lit(None).cast("string")).withColumn("sentiment", F.when(F.col("phi") == "POS", "positive").otherwise("negative")).withColumn("mean_logp", F.lit(0.0))


def probe_counters(found: DataFrame, reviews: DataFrame) -> DataFrame:
    """(period, stratum, code, n): hits by period and code and by period, stratum and code, reviews by period and by period
    and stratum; what a count doesn't go by is null."""
    hits_ = found.groupingSets([["period", "code"], ["period", "stratum", "code"]], "period", "stratum", "code").agg(F.count("*").alias("n"))
    seen = reviews.groupingSets([["period"], ["period", "stratum"]], "period", "stratum").agg(F.count("*").alias("n")).withColumn("code", F.lit(None).cast("string"))
    return hits_.unionByName(seen.select("period", "stratum", "code", "n"))


def probe_shares(found: DataFrame, reviews: DataFrame, codes: DataFrame, least: int = 30) -> DataFrame:
    """(period, code, raw, adj): found(period, stratum, code) one row a hit, reviews(period, stratum) one a review.

    Strata with fewer than `least` reviews in a period are left out of adj, unlike in the drift run.
    """
    n = reviews.groupBy("period", "stratum").agg(F.count("*").alias("reviews"))
    ref = n.groupBy("stratum").agg(F.sum("reviews").alias("w")).select("stratum", (F.col("w") / F.sum("w").over(Window.partitionBy())).alias("wref"))
    full = n.join(ref, "stratum").crossJoin(codes).join(found.groupBy("period", "stratum", "code").agg(F.count("*").alias("c")), ["period", "stratum", "code"], "left").fillna(0, ["c"])
    st = F.sum("c").over(Window.partitionBy("period", "stratum"))
    part = F.when((F.col("reviews") >= least) & (st > 0), F.col("wref") * F.col("c") / F.nullif(st, F.lit(0))).otherwise(0.0)
    acc = full.withColumn("part", part).groupBy("period", "code").agg(F.sum("c").cast("double").alias("raw"), F.sum("part").alias("adj"))
    unit = lambda c: F.coalesce(F.col(c) / F.nullif(F.sum(c).over(Window.partitionBy("period")), F.lit(0.0)), F.lit(0.0))
    return acc.select("period", "code", unit("raw").alias("raw"), unit("adj").alias("adj"))
