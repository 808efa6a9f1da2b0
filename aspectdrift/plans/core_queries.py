"""Queries over the quad view: cells, shares, series, tests; with the same rows in DuckDB."""

from __future__ import annotations

from pyspark.sql import functions as F

from aspectdrift.operators import aggregate, inference, series
from aspectdrift import config
from aspectdrift.plans import drift, sql_parts
from aspectdrift.plans.quad_view import SQL as QUADS
from aspectdrift.plans.quad_view import quads
from aspectdrift.plans.sql_parts import STATS
from aspectdrift.sources.scratch import staged

QUERIES, ORACLE = {}, {}
N_PERM, N_BOOT, SEED = config.PERMUTATIONS, 100, 7


def r6(*names):
    return [F.round(n, 6).alias(n) for n in names]


def cells_once(spark, d, level="category"):
    """The cell table, a few rows a period, written once: shares, references and dimensions all read it."""
    return staged(aggregate.cells(quads(spark, d), level))


def category_cells(spark, d):
    return cells_once(spark, d)


# ---------------------------------------------------------------- shared SQL

CELLS = f"""WITH {QUADS},
cells AS (SELECT period, stratum, CASE WHEN {{code}} AND reportable THEN taxonomy_code ELSE category END AS aspect, sum(w) AS total,
  sum(CASE WHEN sentiment = 'negative' THEN w ELSE 0 END) AS neg, sum(CASE WHEN phi = 'NEG' OR sentiment = 'negative' THEN w ELSE 0 END) AS complaint,
  count(*) FILTER (phi = 'NEG' OR sentiment = 'negative') AS n_complaints FROM quads WHERE w > 0 GROUP BY ALL)"""
CAT, CODE = CELLS.format(code="false"), CELLS.format(code="true")
SHARES = """pi AS (SELECT period, stratum, aspect, complaint AS w FROM cells WHERE n_complaints > 0),
ref AS (SELECT stratum, sum(complaint) / (SELECT sum(complaint) FROM cells) AS wref FROM cells GROUP BY stratum),
asp AS (SELECT DISTINCT aspect FROM cells),
full_grid AS (SELECT p.period, r.stratum, r.wref, a.aspect, coalesce(pi.w, 0) AS w FROM (SELECT DISTINCT period FROM pi) p CROSS JOIN ref r CROSS JOIN asp a
  LEFT JOIN pi ON pi.period = p.period AND pi.stratum = r.stratum AND pi.aspect = a.aspect),
tot AS (SELECT *, sum(w) OVER (PARTITION BY period, stratum) AS n_st, sum(w) OVER (PARTITION BY period, aspect) AS pooled, sum(w) OVER (PARTITION BY period) AS all_w FROM full_grid),
acc AS (SELECT period, aspect, max(pooled) AS raw, sum(wref * (w + 30.0e0 * pooled / all_w) / (n_st + 30.0e0)) AS adj FROM tot GROUP BY period, aspect),
shares AS (SELECT period, aspect, raw / sum(raw) OVER (PARTITION BY period) AS raw, adj / sum(adj) OVER (PARTITION BY period) AS adj FROM acc)"""
VALENCES = """vref AS (SELECT stratum, sum(total) / (SELECT sum(total) FROM cells) AS wref FROM cells GROUP BY stratum),
vgrid AS (SELECT p.period, r.stratum, r.wref, a.aspect, coalesce(c.neg, 0) AS neg, coalesce(c.total, 0) AS total FROM (SELECT DISTINCT period FROM cells) p CROSS JOIN vref r
  CROSS JOIN (SELECT DISTINCT aspect FROM cells) a LEFT JOIN cells c ON c.period = p.period AND c.stratum = r.stratum AND c.aspect = a.aspect),
vtot AS (SELECT *, sum(neg) OVER w / nullif(sum(total) OVER w, 0) AS nu0 FROM vgrid WINDOW w AS (PARTITION BY period, aspect)),
val AS (SELECT period, aspect, max(nu0) AS raw, sum(wref * (neg + 10.0e0 * nu0) / (total + 10.0e0)) / sum(wref) AS adj FROM vtot GROUP BY period, aspect)"""
CLR = """logs AS (SELECT period, aspect, ln(greatest(raw, 1e-6)) - avg(ln(greatest(raw, 1e-6))) OVER (PARTITION BY period) AS clr_raw,
  ln(greatest(adj, 1e-6)) - avg(ln(greatest(adj, 1e-6))) OVER (PARTITION BY period) AS clr_adj FROM shares)"""
ADJ_SERIES = "src AS (SELECT aspect AS series_id, 0 AS b, row_number() OVER (PARTITION BY aspect ORDER BY period) - 1 AS x, period, clr_adj AS value FROM logs)"


def query(name, sql=None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return put


# ---------------------------------------------------------------- cells


@query("complaint_cells", f"{CODE} SELECT period, stratum, aspect, round(complaint, 6) AS w, CAST(n_complaints AS BIGINT) AS n FROM cells WHERE n_complaints > 0")
def complaint_cells(spark, d):
    return aggregate.cells(quads(spark, d)).where("n_complaints > 0").select("period", "stratum", "aspect", F.round("complaint", 6).alias("w"), F.col("n_complaints").alias("n"))


@query("valence_cells", f"""{CODE} SELECT period, stratum, CASE WHEN reportable THEN taxonomy_code ELSE category END AS aspect, sentiment, round(sum(w), 6) AS w
FROM quads WHERE w > 0 GROUP BY ALL""")
def valence_cells(spark, d):
    rows = aggregate.rolled_up(quads(spark, d).where("w > 0"))
    return rows.groupBy("period", "stratum", "aspect", "sentiment").agg(F.round(F.sum("w"), 6).alias("w"))


@query("review_vectors", f"""WITH {QUADS} SELECT period, stratum, review_uid, CASE WHEN reportable THEN taxonomy_code ELSE category END AS aspect, round(sum(w), 6) AS w
FROM quads WHERE w > 0 AND (phi = 'NEG' OR sentiment = 'negative') GROUP BY ALL""")
def review_vectors(spark, d):
    return aggregate.review_vectors(quads(spark, d)).withColumn("w", F.round("w", 6))


@query("reference_composition", f"""{CAT} SELECT 'pi' AS kind, stratum, round(sum(complaint) / (SELECT sum(complaint) FROM cells), 6) AS wref FROM cells GROUP BY stratum
UNION ALL SELECT 'nu', stratum, round(sum(total) / (SELECT sum(total) FROM cells), 6) FROM cells GROUP BY stratum""")
def reference_composition(spark, d):
    cell = category_cells(spark, d)
    kind = lambda name, column: aggregate.reference(cell, column).select(F.lit(name).alias("kind"), "stratum", *r6("wref"))
    return kind("pi", "complaint").unionByName(kind("nu", "total"))


# ---------------------------------------------------------------- shares, valences


def _shares(spark, d, level="category"):
    cell = cells_once(spark, d, level)
    return aggregate.shares(aggregate.complaints(cell), aggregate.reference(cell, "complaint"), cell.select("aspect").distinct())


@query("shares_raw", f"{CAT}, {SHARES} SELECT period, aspect, round(raw, 6) AS share FROM shares")
def shares_raw(spark, d):
    return _shares(spark, d).select("period", "aspect", F.round("raw", 6).alias("share"))


@query("shares_adj", f"{CODE}, {SHARES} SELECT period, aspect, round(adj, 6) AS share FROM shares")
def shares_adj(spark, d):
    return _shares(spark, d, "taxonomy_code").select("period", "aspect", F.round("adj", 6).alias("share"))


def _valences(spark, d):
    cell = category_cells(spark, d)
    return aggregate.valences(cell, aggregate.reference(cell, "total"))


@query("valence_raw", f"{CAT}, {VALENCES} SELECT period, aspect, round(raw, 6) AS nu FROM val")
def valence_raw(spark, d):
    return _valences(spark, d).select("period", "aspect", F.round("raw", 6).alias("nu"))


@query("valence_adj", f"{CAT}, {VALENCES} SELECT period, aspect, round(adj, 6) AS nu FROM val")
def valence_adj(spark, d):
    return _valences(spark, d).select("period", "aspect", F.round("adj", 6).alias("nu"))


@query("clr_series", f"{CAT}, {SHARES}, {CLR} SELECT period, aspect, round(clr_raw, 6) AS clr_raw, round(clr_adj, 6) AS clr_adj FROM logs")
def clr_series(spark, d):
    return aggregate.clr(aggregate.clr(_shares(spark, d), "raw"), "adj").select("period", "aspect", *r6("clr_raw", "clr_adj"))


# ---------------------------------------------------------------- series


def _adj_series(spark, d):
    return aggregate.clr(_shares(spark, d), "adj").select(F.col("aspect").alias("series_id"), "period", F.col("clr_adj").alias("value"))


@query("calendar", "SELECT strftime(m, '%Y-%m') AS period, CAST(row_number() OVER (ORDER BY m) AS BIGINT) AS n FROM (SELECT unnest(generate_series(DATE '2022-03-01', DATE '2025-02-01', INTERVAL 1 MONTH)) AS m)")
def calendar(spark, d):
    from aspectdrift.functions.calendar import periods

    return periods(spark, "2022-03", "2025-02")


@query("deseason", f"{CAT}, {SHARES}, {CLR}, {ADJ_SERIES}, {STATS} SELECT series_id, period, CAST(x AS BIGINT) AS x, round(y, 6) AS y FROM des")
def deseason(spark, d):
    return series.deseason(series.points(_adj_series(spark, d))).select("series_id", "period", F.col("x").cast("long").alias("x"), *r6("y"))


@query("ols_trend", f"{CAT}, {SHARES}, {CLR}, {ADJ_SERIES}, {STATS} SELECT series_id AS aspect, CAST(n AS BIGINT) AS n, round(slope_per_year, 6) AS slope_per_year, round(t_stat, 4) AS t_stat FROM tr")
def ols_trend(spark, d):
    return drift.trends(category_cells(spark, d)).select("aspect", F.col("n").cast("long").alias("n"), F.round("slope_per_year", 6).alias("slope_per_year"), F.round("t_stat", 4).alias("t_stat"))


@query("best_split", f"{CAT}, {SHARES}, {CLR}, {ADJ_SERIES}, {STATS} SELECT series_id, CAST(split AS BIGINT) AS split, round(split_t, 4) AS split_t, changepoint FROM sp")
def best_split(spark, d):
    rows = series.best_split(series.deseason(series.points(_adj_series(spark, d))))
    return rows.select("series_id", F.col("split").cast("long").alias("split"), F.round("split_t", 4).alias("split_t"), "changepoint")


PERMUTED = f"""obs AS (SELECT aspect AS series_id, row_number() OVER (PARTITION BY aspect ORDER BY period) - 1 AS x, period, clr_adj AS value FROM logs),
perm AS (SELECT o.series_id, b, row_number() OVER (PARTITION BY o.series_id, b ORDER BY CASE WHEN b = 0 THEN lpad(CAST(x AS VARCHAR), 8, '0') ELSE md5('{SEED}|' || o.series_id || '|' || b || '|' || x) END) - 1 AS x, value
  FROM obs o CROSS JOIN (SELECT unnest(range({N_PERM} + 1)) AS b)),
src AS (SELECT p.series_id, p.b, p.x, o.period, p.value FROM perm p JOIN obs o ON p.series_id = o.series_id AND p.x = o.x)"""
PVALUES = f"""pv AS (SELECT t.series_id, (count(*) FILTER (t.b > 0 AND abs(t.t_stat) >= abs(o.t_stat) - 1e-9) + 1) / ({N_PERM} + 1) AS p_trend,
  (count(*) FILTER (t.b > 0 AND s.split_t >= os.split_t - 1e-9) + 1) / ({N_PERM} + 1) AS p_split FROM tr t JOIN sp s USING (series_id, b)
  JOIN (SELECT * FROM tr WHERE b = 0) o ON o.series_id = t.series_id JOIN (SELECT * FROM sp WHERE b = 0) os ON os.series_id = t.series_id GROUP BY t.series_id)"""


@query("permutation_p", f"{CAT}, {SHARES}, {CLR}, {PERMUTED}, {STATS}, {PVALUES} SELECT series_id, round(p_trend, 6) AS p_trend, round(p_split, 6) AS p_split FROM pv")
def permutation_p(spark, d):
    return inference.permutation_p(_adj_series(spark, d), N_PERM, SEED).select("series_id", *r6("p_trend", "p_split"))


def boot(replicates, seed, quads_="quads", cells="cells"):
    """SQL up to src: each review counts as often as a Poisson draw from the hash of seed, replicate and review says."""
    return f"""rv AS (SELECT period, stratum, review_uid, category AS aspect, sum(w) AS w FROM {quads_} WHERE w > 0 AND (phi = 'NEG' OR sentiment = 'negative') GROUP BY ALL),
dr AS (SELECT *, {sql_parts.poisson("u")} AS times FROM (SELECT *, CAST('0x' || substr(md5('{seed}|' || ((b - 1) // 4) || '|' || review_uid), CAST(8 * ((b - 1) % 4) + 1 AS BIGINT), 8) AS BIGINT) / 4294967296.0e0 AS u FROM rv CROSS JOIN (SELECT unnest(range(1, {replicates} + 1)) AS b))),
bc AS (SELECT b, period, stratum, aspect, sum(times * w) AS w FROM dr WHERE times > 0 GROUP BY ALL),
bref AS (SELECT stratum, sum(complaint) / (SELECT sum(complaint) FROM {cells}) AS wref FROM {cells} GROUP BY stratum),
bg AS (SELECT p.b, p.period, r.stratum, r.wref, a.aspect, coalesce(bc.w, 0) AS w FROM (SELECT DISTINCT b, period FROM bc) p CROSS JOIN bref r CROSS JOIN (SELECT DISTINCT aspect FROM {cells}) a
  LEFT JOIN bc ON bc.b = p.b AND bc.period = p.period AND bc.stratum = r.stratum AND bc.aspect = a.aspect),
bt AS (SELECT *, sum(w) OVER (PARTITION BY b, period, stratum) AS n_st, sum(w) OVER (PARTITION BY b, period, aspect) AS pooled, sum(w) OVER (PARTITION BY b, period) AS all_w FROM bg),
ba AS (SELECT b, period, aspect, sum(wref * (w + 30.0e0 * pooled / all_w) / (n_st + 30.0e0)) AS adj FROM bt GROUP BY ALL),
bl AS (SELECT b, period, aspect, ln(greatest(s, 1e-6)) - avg(ln(greatest(s, 1e-6))) OVER (PARTITION BY b, period) AS v FROM (SELECT *, adj / sum(adj) OVER (PARTITION BY b, period) AS s FROM ba)),
src AS (SELECT aspect AS series_id, b, row_number() OVER (PARTITION BY aspect, b ORDER BY period) - 1 AS x, period, v AS value FROM bl)"""


INTERVALS = "SELECT series_id AS aspect, list_sort(list(slope_per_year)) AS s FROM tr GROUP BY series_id"


@query("bootstrap_ci", f"""{CAT}, {boot(N_BOOT, SEED)}, {STATS}, o AS ({INTERVALS})
SELECT aspect, round(s[CAST(floor(0.025 * len(s)) AS INT) + 1], 6) AS lo, round(s[CAST(floor(0.975 * len(s)) AS INT) + 1], 6) AS hi FROM o""")
def bootstrap_ci(spark, d):
    rows, cell = quads(spark, d), cells_once(spark, d)
    slopes = inference.bootstrap_slopes(aggregate.complaint_rows(rows, "category"), aggregate.reference(cell, "complaint"), cell.select("aspect").distinct(), N_BOOT, SEED)
    return inference.interval(slopes).select("aspect", *r6("lo", "hi"))


@query("series_intervals", f"""{CAT}, {boot(N_BOOT, SEED)}, sh AS (SELECT b, period, aspect, adj / sum(adj) OVER (PARTITION BY b, period) AS v FROM ba), o AS (SELECT period, aspect, list_sort(list(v)) AS s FROM sh GROUP BY ALL)
SELECT period, aspect, round(s[CAST(floor(0.025 * len(s)) AS INT) + 1], 6) AS lo, round(s[CAST(floor(0.975 * len(s)) AS INT) + 1], 6) AS hi FROM o""")
def series_intervals(spark, d):
    rows, cell = quads(spark, d), cells_once(spark, d)
    drawn = inference.bootstrap_shares(aggregate.complaint_rows(rows, "category"), aggregate.reference(cell, "complaint"), cell.select("aspect").distinct(), N_BOOT, SEED)
    return inference.interval(drawn, value="adj", by=("period", "aspect")).select("period", "aspect", *r6("lo", "hi"))


@query("collapsed_strata", f"""{CAT}, sm AS (SELECT stratum FROM (SELECT stratum, period, sum(total) AS t FROM cells GROUP BY ALL) GROUP BY stratum HAVING min(t) < 4)
SELECT period, CASE WHEN sm.stratum IS NULL THEN c.stratum ELSE 'other' END AS stratum, aspect, round(sum(total), 6) AS total, round(sum(complaint), 6) AS complaint, CAST(sum(n_complaints) AS BIGINT) AS n FROM cells c LEFT JOIN sm USING (stratum) GROUP BY ALL""")
def collapsed_strata(spark, d):
    return aggregate.collapsed(category_cells(spark, d), 4).select("period", "stratum", "aspect", *r6("total", "complaint"), F.col("n_complaints").alias("n"))


# ---------------------------------------------------------------- tests of many series

P_OF_PARTS = """p AS (SELECT p_brand AS name, 'g' || (min(p_partkey) % 2) AS grid, (sum(p_size) % 997 + 1) / 1000.0e0 AS p FROM part GROUP BY p_brand),
ranked AS (SELECT *, row_number() OVER (PARTITION BY grid ORDER BY p, name) AS k, count(*) OVER (PARTITION BY grid) AS n FROM p),
qs AS (SELECT name, grid, p, least(1, min(p * n / k) OVER (PARTITION BY grid ORDER BY k DESC ROWS UNBOUNDED PRECEDING)) AS q FROM ranked)"""


def _p_of_parts(spark, d):
    rows = spark.read.parquet(f"{d}/part.parquet").groupBy(F.col("p_brand").alias("name")).agg(
        F.concat(F.lit("g"), F.min("p_partkey") % 2).alias("grid"), ((F.sum("p_size") % 997 + 1) / 1000.0).alias("p"))
    return inference.fdr(rows)


@query("bh_fdr", f"WITH {P_OF_PARTS} SELECT name, grid, round(p, 6) AS p, round(q, 6) AS q FROM qs")
def bh_fdr(spark, d):
    return _p_of_parts(spark, d).select("name", "grid", *r6("p", "q"))


@query("fdr_diagnostics", f"""WITH {P_OF_PARTS}, m AS (SELECT grid, count(*) AS m FROM p GROUP BY grid)
SELECT grid, CAST(m AS BIGINT) AS grid_size, round(1 / 201.0e0, 6) AS p_floor, CAST(ceil(m / 0.05e0) - 1 AS BIGINT) AS n_perm_min, m / 201.0e0 <= 0.05e0 AS single_effect_reachable,
  CAST(ceil(1 / 201.0e0 * m / 0.05e0) AS BIGINT) AS min_simultaneous FROM m""")
def fdr_diagnostics(spark, d):
    grids = _p_of_parts(spark, d).groupBy("grid").agg(F.count("*").alias("m"))
    return grids.select("grid", *inference.diagnostic_columns(F.col("m"), 200)).withColumn("p_floor", F.round("p_floor", 6))


@query("verdicts", """WITH c AS (SELECT p_partkey AS id, CASE p_size % 3 WHEN 0 THEN NULL WHEN 1 THEN true ELSE false END AS rs, p_partkey % 2 = 0 AS s,
  CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE round((p_partkey % 5 - 2) / 10.0e0, 4) END AS rv, round((p_size % 5 - 2) / 10.0e0, 4) AS av FROM part)
SELECT id, CASE WHEN s AND coalesce(rs, false) AND coalesce(rv * av, 0) > 0 THEN 'REAL' WHEN coalesce(rs, false) AND NOT s THEN 'SPURIOUS' WHEN s AND NOT coalesce(rs, false) THEN 'MASKED'
  WHEN s AND coalesce(rv * av, 0) < 0 THEN 'SIGN_FLIP' WHEN s THEN 'UNDETERMINED' ELSE 'FLAT' END AS verdict FROM c""")
def verdicts(spark, d):
    part = spark.read.parquet(f"{d}/part.parquet")
    raw = F.when(F.col("p_size") % 3 == 1, True).when(F.col("p_size") % 3 == 2, False)
    raw_slope = F.when(F.col("p_partkey") % 7 != 0, F.round((F.col("p_partkey") % 5 - 2) / 10.0, 4))
    return part.select(F.col("p_partkey").alias("id"), inference.verdict(raw, F.col("p_partkey") % 2 == 0, raw_slope, F.round((F.col("p_size") % 5 - 2) / 10.0, 4)).alias("verdict"))


@query("seasonal_amplitude", f"""{CAT}, {SHARES}, {CLR}, {ADJ_SERIES} SELECT series_id, round(stddev_pop(m), 6) AS amplitude
FROM (SELECT series_id, avg(value) AS m FROM src GROUP BY series_id, substr(period, 6, 2)) GROUP BY series_id""")
def seasonal_amplitude(spark, d):
    return series.seasonal_amplitude(_adj_series(spark, d)).select("series_id", *r6("amplitude"))


RUN = f"WITH {QUADS}, rq AS (SELECT 0 AS run, * FROM quads)"
REPORTED = f"{RUN}, {sql_parts.drift()}"


@query("drift_report", f"{REPORTED} SELECT {sql_parts.REPORT} FROM rep")
def drift_report(spark, d):
    return drift.drift(quads(spark, d), "category")


_BOOT = sql_parts.renamed(f"{boot(N_BOOT, config.SEED, 'rq', 'cells')}, {STATS}", "b_", "src pts des cen fit tr pre wel sp")


@query("drift_report_bootstrap", f"""{REPORTED}, {_BOOT}, o AS ({INTERVALS.replace(" tr ", " b_tr ")})
SELECT {sql_parts.REPORT}, CASE WHEN channel = 'adj' THEN round(s[CAST(floor(0.025 * len(s)) AS INT) + 1], 4) END AS lo, CASE WHEN channel = 'adj' THEN round(s[CAST(floor(0.975 * len(s)) AS INT) + 1], 4) END AS hi FROM rep LEFT JOIN o USING (aspect)""")
def drift_report_bootstrap(spark, d):
    return drift.drift(quads(spark, d), "category", n_boot=N_BOOT)


@query("verdict_counts", f"{REPORTED} SELECT verdict, CAST(count(*) AS BIGINT) AS n FROM (SELECT DISTINCT aspect, verdict FROM rep) GROUP BY verdict")
def verdict_counts(spark, d):
    return inference.verdict_counts(drift.drift(quads(spark, d), "category"))


@query("outside_taxonomy", f"WITH {QUADS} SELECT CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (NOT starts_with(taxonomy_code, 'S')) AS BIGINT) AS outside FROM quads")
def outside_taxonomy(spark, d):
    known = {f"{t}_{k}": t for t in ("STANDARD", "SMALL") for k in range(5)}
    return aggregate.outside(aggregate.with_taxonomy(quads(spark, d), known))
