"""Queries for what stands around the models: extraction, enrichment, training sets, verifier, audit, and the reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from aspectdrift import config
from aspectdrift.functions import strata, text
from aspectdrift.operators import codec, evaluate, lexicon, posterior, reliability, sampling, selftrain, store
from aspectdrift.plans import sql_parts, text_queries
from aspectdrift.plans.quad_view import SQL as QUADS
from aspectdrift.plans.quad_view import quads
from aspectdrift.plans.text_queries import LEXICON, ORACLE, QUERIES, REVIEWS, SEED, TYPES, _found, _store, _t, query
from aspectdrift.sources import jsonl
from aspectdrift.sources.scratch import folder, staged

__all__ = ["ORACLE", "QUERIES"]

# ---------------------------------------------------------------- extraction

_HIT = lambda terms: rf"(^|[^\p{{L}}\p{{N}}_])({'|'.join(sorted(terms, key=lambda t: (-len(t), t)))})([^\p{{L}}\p{{N}}_]|$)"


@query("lexicon_extract", " UNION ALL ".join(
    rf"SELECT doc_id, '{c}' AS taxonomy_code, CASE WHEN doc_id % 2 = 0 THEN 'positive' ELSE 'negative' END AS sentiment, regexp_extract(lower(text), '{_HIT(t)}', 2) AS aspect_term FROM documents WHERE regexp_matches(lower(text), '{_HIT(t)}')" for c, t in LEXICON.items()))
def lexicon_extract(spark, d):
    units = _t(spark, d, "documents").select("doc_id", "text", F.when(F.col("doc_id") % 2 == 0, "POS").otherwise("NEG").alias("phi"))
    return lexicon.extract(units, LEXICON).select("doc_id", "taxonomy_code", "sentiment", "aspect_term")


PROBED = rf"""f AS ({text_queries.FOUND}), n AS (SELECT lpad(CAST(n_chars % 12 + 1 AS VARCHAR), 2, '0') AS period, lang AS stratum FROM documents)"""


@query("probe_counters", f"""WITH {PROBED} SELECT period, NULL AS stratum, code, CAST(count(*) AS BIGINT) AS n FROM f GROUP BY ALL UNION ALL SELECT period, stratum, code, CAST(count(*) AS BIGINT) FROM f GROUP BY ALL
UNION ALL SELECT period, NULL, NULL, CAST(count(*) AS BIGINT) FROM n GROUP BY period UNION ALL SELECT period, stratum, NULL, CAST(count(*) AS BIGINT) FROM n GROUP BY ALL""")
def probe_counters(spark, d):
    docs, found = _found(spark, d)
    return lexicon.probe_counters(found, docs)


FLAT = "part % 9 = 0"
LOGP = {"positive": "-line / 10.0e0", "neutral": f"CASE WHEN {FLAT} THEN -line / 10.0e0 ELSE -(part % 5) / 10.0e0 END", "negative": f"CASE WHEN {FLAT} THEN -line / 10.0e0 ELSE -(part % 7) / 10.0e0 END"}


@query("enriched_quads", f"""WITH {QUADS}, a AS (SELECT *, {LOGP['positive']} AS a, {LOGP['neutral']} AS b, {LOGP['negative']} AS c, ln(conf_seq) AS m FROM quads),
t AS (SELECT *, greatest(a, b, c) - least(a, b, c) < 1e-6 AS flat FROM a), p AS (SELECT *, CASE WHEN flat THEN CASE sentiment WHEN 'positive' THEN 0.9e0 ELSE 0.05e0 END ELSE exp(a) / (exp(a) + exp(b) + exp(c)) END AS pp,
  CASE WHEN flat THEN CASE sentiment WHEN 'neutral' THEN 0.9e0 ELSE 0.05e0 END ELSE exp(b) / (exp(a) + exp(b) + exp(c)) END AS pn, CASE WHEN flat THEN CASE sentiment WHEN 'negative' THEN 0.9e0 ELSE 0.05e0 END ELSE exp(c) / (exp(a) + exp(b) + exp(c)) END AS pg FROM t),
l AS (SELECT *, 0.7e0 * ln(pp) + 0.3e0 * ln(CASE phi WHEN 'POS' THEN 0.931e0 ELSE 0.217e0 END) AS x, 0.7e0 * ln(pn) + 0.3e0 * ln(CASE phi WHEN 'POS' THEN 0.036e0 ELSE 0.142e0 END) AS y, 0.7e0 * ln(pg) + 0.3e0 * ln(CASE phi WHEN 'POS' THEN 0.033e0 ELSE 0.641e0 END) AS z FROM p),
o AS (SELECT *, CASE WHEN x >= y AND x >= z THEN 'positive' WHEN y >= z THEN 'neutral' ELSE 'negative' END AS s FROM l)
SELECT sentiment AS sentiment_model, s AS sentiment, flat AS p_model_truncated, NOT flat AS p_model_exact, s <> sentiment AS provenance_flip, CAST(count(*) AS BIGINT) AS n, round(sum(round(exp(greatest(x, y, z)) / (exp(x) + exp(y) + exp(z)), 4)), 2) AS p_posterior, round(sum(round(exp(m), 4)), 2) AS conf_seq FROM o GROUP BY ALL""")
def enriched_quads(spark, d):
    logp = {k: F.expr(v.replace("e0", "D")) for k, v in LOGP.items()}
    rows = posterior.enriched(quads(spark, d).withColumn("mean_logp", F.ln("conf_seq")), logp)
    sums = [F.round(F.sum(c), 2).alias(c) for c in ("p_posterior", "conf_seq")]
    return rows.groupBy("sentiment_model", "sentiment", "p_model_truncated", "p_model_exact", "provenance_flip").agg(F.count("*").alias("n"), *sums)


@query("quad_names", f"""WITH {QUADS} SELECT review_uid || '_' || phi || '_' || taxonomy_code || '_' || substr(md5({text_queries.NORM.format("opinion_term")}), 1, 6) AS quad_uid, CAST(count(*) AS BIGINT) AS n FROM quads GROUP BY 1""")
def quad_names(spark, d):
    uid = text.quad_uid(F.col("review_uid"), F.col("phi"), F.col("taxonomy_code"), F.col("opinion_term"))
    # Nearly every name is new, so rows move before they are counted: no task counts in a table as long as its input.
    return quads(spark, d).select(uid.alias("quad_uid")).repartition("quad_uid").groupBy("quad_uid").agg(F.count("*").alias("n"))


@query("prf_by_term", f"""WITH {QUADS}, g AS (SELECT review_uid AS i, {text_queries.NORM.format("aspect_term")} AS a, taxonomy_code AS c, {text_queries.NORM.format("opinion_term")} AS o, sentiment AS s, count(*) AS gold FROM quads GROUP BY ALL),
p AS (SELECT review_uid AS i, {text_queries.NORM.format("aspect_term")} AS a, taxonomy_code AS c, {text_queries.NORM.format("opinion_term")} AS o, CASE WHEN part % 7 = 0 THEN 'neutral' ELSE sentiment END AS s, count(*) AS pred FROM quads WHERE part % 5 <> 0 GROUP BY ALL),
b AS (SELECT coalesce(gold, 0) AS gold, coalesce(pred, 0) AS pred, least(coalesce(gold, 0), coalesce(pred, 0)) AS hits FROM g FULL JOIN p USING (i, a, c, o, s)) SELECT {text_queries.PRF} FROM b""")
def prf_by_term(spark, d):
    """Predictions write terms in capitals and with other signs; the match key doesn't mind."""
    rows = staged(quads(spark, d).select(F.col("review_uid").alias("instance_id"), "aspect_term", "taxonomy_code", "opinion_term", "sentiment", "part"))
    key = lambda a, o, s: text.match_key(a, F.col("taxonomy_code"), o, s).alias("key")
    gold = rows.select("instance_id", key(F.col("aspect_term"), F.col("opinion_term"), F.col("sentiment")))
    loud = F.concat(F.lit("¡"), F.upper("aspect_term"), F.lit("! "))
    predicted = rows.where("part % 5 <> 0").select("instance_id", key(loud, F.upper("opinion_term"), F.when(F.col("part") % 7 == 0, "neutral").otherwise(F.col("sentiment"))))
    return evaluate.prf(evaluate.bag_counts(gold, predicted, "instance_id", "key"))


# ---------------------------------------------------------------- training sets

SPLIT = "CASE CAST(review_uid AS BIGINT) % 10 WHEN 8 THEN 'dev' WHEN 9 THEN 'test' ELSE 'train' END"


def _training(spark, d):
    """Segments with their split, date and target."""
    segments = text_queries._segments(spark, d)
    meta = _t(spark, d, "orders").where("o_orderkey % 7 <> 0").select(F.col("o_orderkey").cast("string").alias("source_review_id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("review_date"))
    split = F.when(F.col("source_review_id").cast("long") % 10 == 8, "dev").when(F.col("source_review_id").cast("long") % 10 == 9, "test").otherwise("train")
    rows = codec.training_rows(codec.dated(segments, meta)).withColumn("split", split)
    return rows.withColumn("n_parsed", F.size(codec.parse_linearized(F.col("target"), text_queries.TAXONOMY)))


@query("data_report", f"WITH {QUADS} SELECT {SPLIT} AS split, CAST(count(DISTINCT review_uid) AS BIGINT) AS segments, CAST(count(*) AS BIGINT) AS quads, CAST(0 AS BIGINT) AS mismatches FROM quads GROUP BY 1")
def data_report(spark, d):
    return codec.data_report(_training(spark, d))


@query("chronological_split", f"""WITH {QUADS}, s AS (SELECT DISTINCT review_uid FROM quads WHERE {SPLIT} <> 'test'), r AS (SELECT s.review_uid, CASE WHEN o_orderkey % 7 <> 0 THEN strftime(o_orderdate, '%Y-%m') END AS m FROM s JOIN orders ON CAST(s.review_uid AS BIGINT) = o_orderkey)
SELECT CASE WHEN m IS NULL THEN 'undated' WHEN m <= '1998-06' THEN 'train' WHEN m >= '1998-07' THEN 'test' ELSE 'between' END AS part, CAST(count(*) AS BIGINT) AS n FROM r GROUP BY 1""")
def chronological_split(spark, d):
    rows = _training(spark, d)
    return codec.chronological([rows.where("split = 'train'"), rows.where("split = 'dev'")], "1998-06", "1998-07").groupBy("part").agg(F.count("*").alias("n"))


@query("training_prompts", f"""WITH {QUADS}, t AS (SELECT review_uid, 'extract quads: ' || string_agg(aspect_term, ' ' ORDER BY line, taxonomy_code, aspect_term, opinion_term, sentiment, phi) AS input FROM quads GROUP BY review_uid)
SELECT review_uid AS instance_id, md5(input) AS input_md5 FROM t""")
def training_prompts(spark, d):
    return _training(spark, d).select("instance_id", F.md5("input").alias("input_md5"))


@query("training_bag", f"""WITH {QUADS}, g AS (SELECT review_uid, count(*) AS n FROM quads GROUP BY review_uid), p AS (SELECT review_uid, phi, count(*) AS n FROM quads WHERE conf_seq >= 0.95 AND w >= 0.93 GROUP BY ALL)
SELECT 'gold' AS origin, CAST(count(*) AS BIGINT) AS n, CAST(sum(n) AS BIGINT) AS quads FROM g UNION ALL SELECT 'pseudo', CAST(count(*) AS BIGINT), CAST(sum(n) AS BIGINT) FROM p""")
def training_bag(spark, d):
    pseudo = selftrain.pseudo_rows(text_queries._unit_quads(spark, d), 0.95, 0.93)
    rows = selftrain.training_set(_training(spark, d), pseudo)
    return rows.groupBy("origin").agg(F.count("*").alias("n"), F.sum("n_quads").cast("long").alias("quads"))


@query("skew_stop", f"""WITH {QUADS}, g AS (SELECT avg(CASE WHEN sentiment = 'negative' THEN 1.0e0 ELSE 0 END) AS gold_rate FROM quads), p AS (SELECT count(*) AS n, avg(CASE WHEN sentiment = 'negative' THEN 1.0e0 ELSE 0 END) AS rate FROM quads WHERE conf_seq >= 0.95 AND w >= 0.93)
SELECT CAST(n AS BIGINT) AS n, round(rate, 6) AS rate, round(gold_rate, 6) AS gold_rate, n = 0 OR abs(rate - gold_rate) > 0.15 AS stop FROM p, g""")
def skew_stop(spark, d):
    out = selftrain.skewed(text_queries._segments(spark, d), selftrain.pseudo_rows(text_queries._unit_quads(spark, d), 0.95, 0.93))
    return out.withColumn("rate", F.round("rate", 6)).withColumn("gold_rate", F.round("gold_rate", 6))


@query("pseudo_label_sample", f"""WITH {QUADS}, u AS (SELECT review_uid, phi, count(*) FILTER (conf_seq >= 0.95 AND w >= 0.93) AS n_quads FROM quads GROUP BY ALL),
f AS (SELECT * FROM u WHERE n_quads > 0 ORDER BY md5('{SEED}|' || review_uid || '|' || phi), review_uid, phi LIMIT 300), e AS (SELECT * FROM u WHERE n_quads = 0 ORDER BY md5('{SEED + 1}|' || review_uid || '|' || phi), review_uid, phi LIMIT (SELECT CAST(floor(0.25 * count(*)) AS BIGINT) FROM f))
SELECT review_uid, phi, CAST(n_quads AS BIGINT) AS n_quads FROM f UNION ALL SELECT review_uid, phi, CAST(n_quads AS BIGINT) FROM e""")
def pseudo_label_sample(spark, d):
    """A sampling operator: a cap of 300 units with quads, and a quarter as many empty ones."""
    rows = selftrain.pseudo_rows(text_queries._unit_quads(spark, d), 0.95, 0.93, 300, 0.25, SEED)
    return rows.select("review_uid", "phi", F.col("n_quads").cast("long").alias("n_quads"))


# ---------------------------------------------------------------- verifier, audit

CATS = list(TYPES)
_COS = "((CAST(image AS BIGINT) * 7 + length(category) * 13) % 9973) / 9973.0e0 + CASE WHEN y = 1 THEN 0.25e0 ELSE 0 END"
PAIRS = f"""img AS (SELECT CAST(o_orderkey AS VARCHAR) AS image FROM orders WHERE o_orderkey % 3 = 0), of_ AS (SELECT DISTINCT review_uid AS image, category FROM quads SEMI JOIN img ON img.image = review_uid),
n_ AS (SELECT image, count(*) AS n_pos FROM of_ GROUP BY image), neg_ AS (SELECT image, n_pos, c.category FROM n_ CROSS JOIN (SELECT unnest({CATS}) AS category) c ANTI JOIN of_ ON of_.image = n_.image AND of_.category = c.category),
all_ AS (SELECT image, category, 1 AS y FROM of_ UNION ALL SELECT image, category, 0 FROM neg_ QUALIFY row_number() OVER (PARTITION BY image ORDER BY md5('{SEED}|' || image || '|' || category), image, category) <= n_pos),
pairs AS (SELECT *, CASE CAST(image AS BIGINT) % 5 WHEN 0 THEN 'test' WHEN 1 THEN 'dev' ELSE 'train' END AS split, {_COS} AS sim FROM all_)"""


def _pairs(spark, d):
    images = _t(spark, d, "orders").where("o_orderkey % 3 = 0").select(F.col("o_orderkey").cast("string").alias("review"), F.col("o_orderkey").cast("string").alias("image"))
    named = quads(spark, d).select(F.concat_ws("", "review_uid", F.lit("_Q"), "line").alias("quad_id"), "category")
    splits = _t(spark, d, "orders").where("o_orderkey % 5 < 2").select(F.col("o_orderkey").cast("string").alias("review"), F.when(F.col("o_orderkey") % 5 == 0, "test").otherwise("dev").alias("split"))
    categories = spark.createDataFrame([(c,) for c in CATS], "category string")
    rows = reliability.verifier_pairs(images, named, splits, categories, SEED)
    return rows.withColumn("sim", F.expr(_COS.replace("e0", "D")))


@query("verifier_pairs", f"WITH {QUADS}, {PAIRS} SELECT image, category, CAST(y AS BIGINT) AS y, split FROM pairs")
def verifier_pairs(spark, d):
    return _pairs(spark, d).select("image", "category", F.col("y").cast("long").alias("y"), "split")


_AUC = lambda score: f"(SELECT (sum(k) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2.0e0) / (count(*) FILTER (y = 1) * count(*) FILTER (y = 0)) FROM (SELECT y, rank() OVER (ORDER BY {score}) + (count(*) OVER (PARTITION BY {score}) - 1) / 2.0e0 AS k FROM t_))"
_MARKS = [f"CAST(category = '{c}' AS DOUBLE)" for c in CATS]
VERIFIER = f"""data AS MATERIALIZED (SELECT sim AS f0, {', '.join(f'{m} AS f{i + 1}' for i, m in enumerate(_MARKS))}, CAST(y AS DOUBLE) AS y, 1.0e0 AS w FROM pairs WHERE split <> 'test'), {sql_parts.newton(7, 12, "nv")},
base AS MATERIALIZED (SELECT {', '.join(f'f{i + 1} AS f{i}' for i in range(6))}, y, w FROM data), {sql_parts.newton(6, 12, "nb").replace("FROM data,", "FROM base,")},
t_ AS (SELECT pairs.*, 1 / (1 + exp(-(v.b0 * sim + {' + '.join(f'v.b{i + 1} * {m}' for i, m in enumerate(_MARKS))} + v.b7))) AS score, round(1 / (1 + exp(-({' + '.join(f'p.b{i} * {m}' for i, m in enumerate(_MARKS))} + p.b6))), 9) AS plain FROM pairs, nv12 v, nb12 p WHERE split = 'test')"""


@query("verifier_gain", f"WITH {QUADS}, {PAIRS}, {VERIFIER}, a_ AS (SELECT {_AUC('score')} AS auc, {_AUC('plain')} AS baseline) SELECT round(auc, 5) AS auc, round(baseline, 5) AS baseline, round(auc - baseline, 5) AS gain, CASE WHEN auc >= 0.7 AND auc - baseline >= 0.05 THEN 'GO' ELSE 'NO-GO' END AS verdict FROM a_")
def verifier_gain(spark, d):
    _, _, report, _ = reliability.fit_verifier(staged(_pairs(spark, d)), CATS)
    return spark.createDataFrame([(round(report["auc"], 5), round(report["baseline"], 5), round(report["gain"], 5), report["verdict"])], "auc double, baseline double, gain double, verdict string")


@query("verifier_by_category", f"""WITH {QUADS}, {PAIRS}, r AS (SELECT category, y, rank() OVER w + (count(*) OVER (PARTITION BY category, sim) - 1) / 2.0e0 AS k FROM pairs WHERE split = 'test' WINDOW w AS (PARTITION BY category ORDER BY sim))
SELECT category, CAST(count(*) AS BIGINT) AS n, round((sum(k) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2.0e0) / nullif(count(*) FILTER (y = 1) * count(*) FILTER (y = 0), 0), 6) AS auc FROM r GROUP BY category""")
def verifier_by_category(spark, d):
    return evaluate.auc(_pairs(spark, d).where("split = 'test'"), "sim", "y", "category").select("category", "n", F.round("auc", 6).alias("auc"))


MARKED = "(CAST(review_uid AS BIGINT) + line + CAST(conf_seq * 100 AS INT)) % 3 > 0"


@query("audit_gate", f"""WITH {QUADS}, q AS (SELECT *, review_uid || '-' || line || '-' || part || '-' || hotel_id AS uid FROM quads), a AS (SELECT uid, max(CAST({MARKED} AS INT)) AS correct FROM q WHERE part % 4 = 1 GROUP BY uid),
r AS (SELECT 1 / (1 + exp(-(1.5e0 * conf_seq - 0.4e0 * w + 0.3e0 * CASE WHEN phi = 'POS' THEN 1 ELSE 0 END + 0.2e0 * ln(1 + n_words) - 0.7e0 * CASE WHEN phi = 'POS' AND sentiment = 'negative' THEN 1 ELSE 0 END - 0.5e0))) AS r, correct FROM q JOIN a USING (uid)),
k AS (SELECT rank() OVER (ORDER BY r) + (count(*) OVER (PARTITION BY r) - 1) / 2.0e0 AS x, rank() OVER (ORDER BY correct) + (count(*) OVER (PARTITION BY correct) - 1) / 2.0e0 AS y FROM r)
SELECT CAST(count(*) AS BIGINT) AS n, round(corr(x, y), 4) AS rho, CASE WHEN count(*) >= 30 AND corr(x, y) >= 0.3 THEN 'GO' ELSE 'NO-GO' END AS verdict FROM k""")
def audit_gate(spark, d):
    rows = text_queries._scored(spark, d).withColumn("quad_uid", F.concat_ws("-", "review_uid", "line", "part", "hotel_id"))
    rows = staged(rows.select("quad_uid", "review_uid", "line", "part", "conf_seq", "p_posterior", "phi", "n_words", "provenance_flip"))  # rows and their marks
    audit = rows.where("part % 4 = 1").select("quad_uid", F.expr(MARKED).cast("int").alias("correct"), F.lit(2).alias("at"))
    earlier = audit.withColumn("correct", 1 - F.col("correct")).withColumn("at", F.lit(1))  # a mark that was changed later
    return reliability.bridge_gate(rows, audit.unionByName(earlier), text_queries.MODEL, "at").withColumn("rho", F.round("rho", 4))


@query("d0_sample", f"""WITH {REVIEWS}, v AS (SELECT lang || '_' || replace(iso, '-', '') || '_' || lpad(CAST(doc_id AS VARCHAR), 8, '0') AS review_uid, substr(iso, 1, 7) AS period, len(regexp_extract_all(pos || ' ' || neg, '\\S+')) AS w, neg <> '' AS has_neg FROM st WHERE NOT in_gold AND (pos <> '' OR neg <> '')),
b AS (SELECT *, CASE WHEN w < 15 THEN 'L0' WHEN w < 45 THEN 'L1' ELSE 'L2' END AS length_bin FROM v), c AS (SELECT *, row_number() OVER (PARTITION BY length_bin, has_neg ORDER BY md5('{SEED}|' || review_uid), review_uid) AS r FROM b)
SELECT review_uid, period, length_bin, has_neg FROM c WHERE r <= least(200, greatest(1, 60 // (SELECT count(*) FROM (SELECT DISTINCT length_bin, has_neg FROM b)))) ORDER BY md5('{SEED + 1}|' || review_uid), review_uid LIMIT 60""")
def d0_sample(spark, d):
    """A sampling operator: 60 reviews to be annotated."""
    return sampling.review_sample(_store(spark, d), 60, SEED).select("review_uid", "period", "length_bin", "has_neg")


CUBE = "conf_seq * conf_seq * conf_seq * conf_seq"


@query("audit_sample", f"""WITH {QUADS}, b AS (SELECT review_uid || '-' || line || '-' || part || '-' || hotel_id AS quad_uid, phi, phi = 'POS' AND sentiment = 'negative' AS provenance_flip, CASE WHEN {CUBE} < 0.6 THEN 'lo' WHEN {CUBE} < 0.85 THEN 'mid' ELSE 'hi' END AS conf_band FROM quads),
c AS (SELECT *, row_number() OVER (PARTITION BY conf_band, phi, provenance_flip ORDER BY md5('{SEED + 1}|' || quad_uid), quad_uid) AS r FROM b)
SELECT quad_uid, conf_band, phi, provenance_flip FROM c WHERE r <= least(300, greatest(1, 100 // (SELECT count(*) FROM (SELECT DISTINCT conf_band, phi, provenance_flip FROM b)))) ORDER BY md5('{SEED + 2}|' || quad_uid), quad_uid LIMIT 100""")
def audit_sample(spark, d):
    """A sampling operator: 100 quads to be marked, alike from each band, side and flip."""
    c = F.col("conf_seq")
    rows = text_queries._scored(spark, d).withColumn("quad_uid", F.concat_ws("-", "review_uid", "line", "part", "hotel_id")).withColumn("conf_seq", c * c * c * c)
    return sampling.quad_sample(rows, 100, SEED).select("quad_uid", "conf_band", "phi", "provenance_flip")


# ---------------------------------------------------------------- sources, dimensions


@query("numbered_lines", "SELECT CAST(count(*) AS BIGINT) AS n, CAST(min(1) AS BIGINT) AS first, CAST(count(*) AS BIGINT) AS last, CAST(count(DISTINCT o_orderkey) AS BIGINT) AS numbers FROM orders")
def numbered_lines(spark, d):
    rows = jsonl.with_line(_t(spark, d, "orders").repartition(5, "o_custkey"))
    return rows.agg(F.count("*").alias("n"), F.min("line").alias("first"), F.max("line").alias("last"), F.count_distinct("line").alias("numbers"))


@query("report_roundtrip", "SELECT n_name AS name, CAST(n_nationkey AS BIGINT) AS k, CAST(n_regionkey AS BIGINT) AS r FROM nation")
def report_roundtrip(spark, d):
    rows, path = _t(spark, d, "nation").select(F.col("n_name").alias("name"), F.col("n_nationkey").cast("long").alias("k"), F.col("n_regionkey").cast("long").alias("r")), folder(spark) + "/report.json"
    jsonl.write_report(rows, path)
    return jsonl.read_report(spark, path, rows.schema)


@query("months_apart", "SELECT o_orderkey AS k, CAST(abs((year(o_orderdate) * 12 + month(o_orderdate)) - (1998 * 12 + 6)) AS INT) AS months FROM orders")
def months_apart(spark, d):
    return _t(spark, d, "orders").select(F.col("o_orderkey").alias("k"), strata.months_apart(F.date_format("o_orderdate", "yyyy-MM"), F.lit("1998-06")).cast("int").alias("months"))


@query("review_vectors_by_weight", f"WITH {QUADS} SELECT CASE WHEN line % 2 = 0 THEN 'w' WHEN line % 3 = 0 THEN 'conf_seq' ELSE 'one' END AS source, round(sum(CASE WHEN line % 2 = 0 THEN w WHEN line % 3 = 0 THEN conf_seq ELSE 1 END), 4) AS w FROM quads GROUP BY 1")
def review_vectors_by_weight(spark, d):
    """The weight of a quad: w, else its confidence, else 1."""
    from aspectdrift.operators import aggregate

    two, three = F.col("line") % 2 == 0, F.col("line") % 3 == 0
    rows = quads(spark, d).withColumn("w", F.when(two, F.col("w"))).withColumn("conf_seq", F.when(three, F.col("conf_seq")))
    return rows.groupBy(F.when(two, "w").when(three, "conf_seq").otherwise("one").alias("source")).agg(F.round(F.sum(aggregate.weight(rows)), 4).alias("w"))
