"""Queries for the further looks at drift, and for the functions that SQL knows by name."""

from __future__ import annotations

from pyspark.sql import functions as F

from aspectdrift.functions import registry
from aspectdrift.operators import signals
from aspectdrift.plans import core_queries, drift, sql_parts
from aspectdrift.plans.core_queries import CAT, CLR, SHARES, _shares
from aspectdrift.plans.quad_view import SQL as QUADS
from aspectdrift.plans.quad_view import quads
from aspectdrift.plans.text_queries import KEY, NORM, SEED, _t

QUERIES, ORACLE = {}, {}


def query(name, sql):
    def put(f):
        QUERIES[name], ORACLE[name] = f, sql
        return f

    return put


@query("js_divergence", f"""{CAT}, {SHARES}, l AS (SELECT *, lag(adj) OVER (PARTITION BY aspect ORDER BY period) AS q FROM shares)
SELECT period, round(sum((CASE WHEN adj > 0 THEN adj * ln(2 * adj / (adj + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * ln(2 * q / (adj + q)) ELSE 0 END) / 2), 9) AS js FROM l WHERE q IS NOT NULL GROUP BY period""")
def js_divergence(spark, d):
    return signals.divergence(_shares(spark, d)).withColumn("js", F.round("js", 9))


@query("drift_signatures", f"""{core_queries.REPORTED}, m AS (SELECT aspect, max((channel = 'adj' AND significant)::INT) = 1 AS a, max((channel = 'val_adj' AND significant)::INT) = 1 AS b FROM rep GROUP BY aspect)
SELECT aspect, CASE WHEN a AND b THEN 'both' WHEN a THEN 'salience' WHEN b THEN 'sentiment' ELSE 'none' END AS signature FROM m""")
def drift_signatures(spark, d):
    rows = drift.drift(quads(spark, d), "category")
    moves = lambda c: F.max((F.col("channel") == c) & F.col("significant"))
    return rows.groupBy("aspect").agg(signals.signature(moves("adj"), moves("val_adj")).alias("signature"))


@query("opinion_drift", """WITH e AS (SELECT label, vec_id % 4 AS p, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), c AS (SELECT label, p, i, avg(x) AS m FROM e GROUP BY ALL)
SELECT CAST(a.label AS VARCHAR) AS aspect, CAST(a.p AS BIGINT) AS period, round(1 - sum(a.m * b.m) / (sqrt(sum(a.m * a.m)) * sqrt(sum(b.m * b.m))), 6) AS drift FROM c a JOIN c b ON b.label = a.label AND b.i = a.i AND b.p = (SELECT max(p) FROM c z WHERE z.label = a.label AND z.p < a.p) GROUP BY a.label, a.p""")
def opinion_drift(spark, d):
    rows = _t(spark, d, "embeddings").select(F.col("label").cast("string").alias("aspect"), (F.col("vec_id") % 4).cast("long").alias("period"), F.col("embedding").alias("vector"))
    return signals.opinion_drift(rows).withColumn("drift", F.round("drift", 6))


@query("sequential_detectors", f"""{CAT}, {SHARES}, {CLR}, s AS (SELECT aspect, period, clr_adj AS v, avg(clr_adj) OVER (PARTITION BY aspect) AS m, row_number() OVER w AS k, count(*) OVER (PARTITION BY aspect) AS n, avg(clr_adj) OVER w AS run FROM logs WINDOW w AS (PARTITION BY aspect ORDER BY period)),
c AS (SELECT *, sum(v - m) OVER w AS s, sum(v - run - 0.005e0) OVER w AS h FROM s WINDOW w AS (PARTITION BY aspect ORDER BY period)), r AS (SELECT *, h - least(min(h) OVER w, 0) AS rise FROM c WINDOW w AS (PARTITION BY aspect ORDER BY period))
SELECT aspect AS series_id, CAST(count(*) AS BIGINT) AS n, round(max(abs(s)), 6) AS cusum, arg_max(period, (round(abs(s), 9), period)) AS cusum_at, round(max(rise), 6) AS page_hinkley,
  round((sum(CASE WHEN k = 1 THEN 1 ELSE 0.2e0 END * pow(0.8e0, n - k) * v) - max(m)) / stddev_pop(v), 6) AS ewma FROM r GROUP BY aspect""")
def sequential_detectors(spark, d):
    out = signals.detectors(core_queries._adj_series(spark, d))
    return out.select("series_id", "n", F.round("cusum", 6).alias("cusum"), "cusum_at", F.round("page_hinkley", 6).alias("page_hinkley"), F.round("ewma", 6).alias("ewma"))


@query("series_agreement", f"{CAT}, {SHARES}, {CLR} SELECT aspect, CAST(count(*) AS BIGINT) AS n, round(corr(clr_raw, clr_adj), 6) AS r FROM logs GROUP BY aspect")
def series_agreement(spark, d):
    from aspectdrift.operators import aggregate

    rows = aggregate.clr(aggregate.clr(_shares(spark, d), "raw"), "adj")
    return signals.agreement(rows, "clr_raw", "clr_adj", "aspect").withColumn("r", F.round("r", 6))


SPAN = f"contains(' ' || {NORM.format('p_name')} || ' ', ' ' || {NORM.format('t')} || ' ')"


@query("span_validity", f"""WITH x AS (SELECT p_partkey AS id, p_name, CASE p_partkey % 4 WHEN 0 THEN NULL WHEN 1 THEN upper(split_part(p_name, ' ', 1)) || '!' WHEN 2 THEN substr(p_name, 2) ELSE p_brand END AS t FROM part)
SELECT id, t IS NULL OR {SPAN} AS valid FROM x""")
def span_validity(spark, d):
    k, name = F.col("p_partkey") % 4, F.col("p_name")
    term = F.when(k == 0, None).when(k == 1, F.concat(F.upper(F.split_part(name, F.lit(" "), F.lit(1))), F.lit("!"))).when(k == 2, F.substring("p_name", 2, 1000)).otherwise(F.col("p_brand"))
    return _t(spark, d, "part").select(F.col("p_partkey").alias("id"), signals.span_valid(term, name).alias("valid"))


_U = sql_parts.uniform(f"'{SEED}'", *KEY)
COMPLAINT = "(phi = 'NEG' OR sentiment = 'negative')"


@query("inject_prevalence", f"WITH {QUADS} SELECT period, CAST(count(*) AS BIGINT) AS n FROM quads WHERE NOT (taxonomy_code = 'SMALL_1' AND period >= '1998-06' AND {COMPLAINT}) OR {_U} < 0.3 GROUP BY period")
def inject_prevalence(spark, d):
    return signals.inject_prevalence(quads(spark, d), "SMALL_1", 0.3, "1998-06", SEED, *KEY).groupBy("period").agg(F.count("*").alias("n"))


@query("inject_length", f"WITH {QUADS} SELECT period, CAST(count(*) AS BIGINT) AS n FROM quads WHERE NOT (n_words >= 45 AND period >= '1998-06') OR {_U} < 0.3 GROUP BY period")
def inject_length(spark, d):
    return signals.inject_length(quads(spark, d), "L2", 0.3, "1998-06", SEED, *KEY).groupBy("period").agg(F.count("*").alias("n"))


@query("inject_opinion", f"WITH {QUADS} SELECT period, CAST(count(*) FILTER (taxonomy_code = 'SMALL_1' AND period >= '1998-06' AND {_U} < 0.4) AS BIGINT) AS n FROM quads GROUP BY period")
def inject_opinion(spark, d):
    rows = signals.inject_opinion(quads(spark, d), "SMALL_1", "injected", 0.4, "1998-06", SEED, *KEY)
    return rows.groupBy("period").agg(F.count_if(F.col("opinion_term") == "injected").alias("n"))


@query("recall_adjusted_shares", f"""WITH {QUADS}, adj AS (SELECT * REPLACE (w / CASE WHEN sentiment = 'negative' AND n_words < 15 THEN 0.5e0 WHEN sentiment = 'negative' AND n_words < 45 THEN 0.8e0 ELSE 1 END AS w) FROM quads),
c AS (SELECT period, category AS aspect, sum(w) AS w FROM adj WHERE {COMPLAINT} GROUP BY ALL) SELECT period, aspect, round(w / sum(w) OVER (PARTITION BY period), 6) AS share FROM c""")
def recall_adjusted_shares(spark, d):
    from aspectdrift.operators import aggregate

    recall = spark.createDataFrame([("negative", "L0", 0.5), ("negative", "L1", 0.8)], "sentiment string, length_bin string, rho double")
    cell = aggregate.cells(drift.recalled(quads(spark, d), recall), "category")
    out = aggregate.shares(aggregate.complaints(cell), aggregate.reference(cell, "complaint"), cell.select("aspect").distinct())
    return out.where("raw > 0").select("period", "aspect", F.round("raw", 6).alias("share"))


@query("sql_functions", rf"""SELECT doc_id, CASE WHEN n_chars < 15 THEN 'L0' WHEN n_chars < 45 THEN 'L1' ELSE 'L2' END AS bin, CASE WHEN n_chars % 100 < 60 THEN 'lo' WHEN n_chars % 100 < 85 THEN 'mid' ELSE 'hi' END AS band,
  CAST(abs((2020 + n_chars % 5 - 2022) * 12 + (n_chars % 12 + 1) - 6) AS INT) AS months, md5({NORM.format('text')}) AS hash, CAST(n_chars % 30 AS INT) AS nights, coalesce(CASE WHEN doc_id % 2 = 0 THEN 0.5e0 END, CASE WHEN doc_id % 3 = 0 THEN 0.25e0 END, 1) AS w FROM documents""")
def sql_functions(spark, d):
    registry.register(spark)
    _t(spark, d, "documents").createOrReplaceTempView("documents_for_functions")
    return spark.sql("""SELECT doc_id, length_bin(int(n_chars)) AS bin, conf_band((n_chars % 100) / 100.0D) AS band, months_between_periods(concat(string(2020 + n_chars % 5), '-', lpad(string(n_chars % 12 + 1), 2, '0')), '2022-06') AS months,
      review_hash(text) AS hash, stay_nights(concat(string(n_chars % 30), ' đêm')) AS nights, quad_weight(if(doc_id % 2 = 0, 0.5D, NULL), if(doc_id % 3 = 0, 0.25D, NULL)) AS w FROM documents_for_functions""")
