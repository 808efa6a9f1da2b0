"""DuckDB SQL for what takes several steps: the drift run over one or more sets of quads, and logistic fits."""

from __future__ import annotations

import re

from aspectdrift import config

#: From src(series_id, b, x, period, value), points in order x from 0, b a permutation: y, trend and split.
STATS = """pts AS (SELECT *, count(*) OVER (PARTITION BY series_id, b) AS n FROM src),
des AS (SELECT *, value - (avg(value) OVER (PARTITION BY series_id, b, substr(period, 6, 2)) - avg(value) OVER (PARTITION BY series_id, b)) AS y FROM pts WHERE n >= 12),
cen AS (SELECT *, y - avg(y) OVER w AS v, x - avg(x) OVER w AS dx FROM des WINDOW w AS (PARTITION BY series_id, b)),
fit AS (SELECT *, sum(v * dx) OVER w / sum(dx * dx) OVER w AS slope FROM cen WINDOW w AS (PARTITION BY series_id, b)),
tr AS (SELECT series_id, b, max(n) AS n, max(slope) * 12 AS slope_per_year, max(slope) / sqrt(sum((v - slope * dx) * (v - slope * dx)) / (max(n) - 2) / sum(dx * dx)) AS t_stat FROM fit GROUP BY series_id, b),
pre AS (SELECT *, sum(v) OVER p AS sl, sum(v * v) OVER p AS ql, sum(v) OVER w AS s, sum(v * v) OVER w AS q FROM cen
  WINDOW w AS (PARTITION BY series_id, b), p AS (PARTITION BY series_id, b ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
wel AS (SELECT series_id, b, x, period, abs(sl / x - (s - sl) / (n - x)) / sqrt(greatest(ql - sl * sl / x, 0) / (x - 1) / x + greatest(q - ql - (s - sl) * (s - sl) / (n - x), 0) / (n - x - 1) / (n - x)) AS t
  FROM pre WHERE x >= 4 AND x < n - 4),
sp AS (SELECT series_id, b, max(t) AS split_t, arg_min(x, (-t, x)) AS split, arg_min(period, (-t, x)) AS changepoint FROM wel GROUP BY series_id, b)"""


def renamed(sql: str, prefix: str, names: str) -> str:
    """The SQL with these table names prefixed, so that it can stand beside itself."""
    return re.sub(rf"\b({'|'.join(names.split())})\b", rf"{prefix}\1", sql)


def uniform(seed: str, *key: str) -> str:
    """functions.text.uniform."""
    return f"CAST('0x' || substr(md5({seed} || '|' || {' || chr(124) || '.join(key)}), 1, 8) AS BIGINT) / 4294967296.0e0"


def drift(level: str = "category", n_perm: int = config.PERMUTATIONS, seed: str = str(config.SEED), channels: tuple[str, ...] = ("raw", "adj", "val_raw", "val_adj")) -> str:
    """Tables up to rep(run, aspect, channel, ...), the drift run of rq(run, quads' columns); seed may use run."""
    aspect = "CASE WHEN reportable THEN taxonomy_code ELSE category END" if level == "taxonomy_code" else "category"
    columns = {"raw": ("clr_raw", "logs"), "adj": ("clr_adj", "logs"), "val_raw": ("raw", "val"), "val_adj": ("adj", "val")}
    series = " UNION ALL ".join(f"SELECT run, aspect, '{c}' AS channel, period, {columns[c][0]} AS value FROM {columns[c][1]}" for c in channels)
    of = lambda c, x: f"max(CASE WHEN channel = '{c}' THEN {x} END) OVER (PARTITION BY run, aspect)"

    def verdict(r: str, a: str) -> str:
        rs, s, sign = f"coalesce({of(r, 'significant::INT')} = 1, false)", f"coalesce({of(a, 'significant::INT')} = 1, false)", f"coalesce({of(r, 'slope_per_year')} * {of(a, 'slope_per_year')}, 0)"
        return f"CASE WHEN {s} AND {rs} AND {sign} > 0 THEN 'REAL' WHEN {rs} AND NOT {s} THEN 'SPURIOUS' WHEN {s} AND NOT {rs} THEN 'MASKED' WHEN {s} AND {sign} < 0 THEN 'SIGN_FLIP' WHEN {s} THEN 'UNDETERMINED' ELSE 'FLAT' END"

    return f"""cells AS MATERIALIZED (SELECT run, period, stratum, {aspect} AS aspect, sum(w) AS total,
  sum(CASE WHEN sentiment = 'negative' THEN w ELSE 0 END) AS neg, sum(CASE WHEN phi = 'NEG' OR sentiment = 'negative' THEN w ELSE 0 END) AS complaint,
  count(*) FILTER (phi = 'NEG' OR sentiment = 'negative') AS n_complaints FROM rq WHERE w > 0 GROUP BY ALL),
pi AS (SELECT run, period, stratum, aspect, complaint AS w FROM cells WHERE n_complaints > 0),
ref AS (SELECT * FROM (SELECT run, stratum, sum(complaint) / sum(sum(complaint)) OVER (PARTITION BY run) AS wref FROM cells GROUP BY run, stratum) WHERE wref > 0),
vref AS (SELECT run, stratum, sum(total) / sum(sum(total)) OVER (PARTITION BY run) AS wref FROM cells GROUP BY run, stratum),
asp AS (SELECT DISTINCT run, aspect FROM cells),
full_grid AS (SELECT run, period, stratum, wref, aspect, coalesce(pi.w, 0) AS w FROM (SELECT DISTINCT run, period FROM pi) JOIN ref USING (run) JOIN asp USING (run) LEFT JOIN pi USING (run, period, stratum, aspect)),
tot AS (SELECT *, sum(w) OVER (PARTITION BY run, period, stratum) AS n_st, sum(w) OVER (PARTITION BY run, period, aspect) AS pooled, sum(w) OVER (PARTITION BY run, period) AS all_w FROM full_grid),
acc AS (SELECT run, period, aspect, max(pooled) AS raw, sum(wref * (w + 30.0e0 * pooled / all_w) / (n_st + 30.0e0)) AS adj FROM tot GROUP BY ALL),
shares AS (SELECT run, period, aspect, raw / sum(raw) OVER (PARTITION BY run, period) AS raw, adj / sum(adj) OVER (PARTITION BY run, period) AS adj FROM acc),
logs AS (SELECT run, period, aspect, ln(greatest(raw, 1e-6)) - avg(ln(greatest(raw, 1e-6))) OVER (PARTITION BY run, period) AS clr_raw,
  ln(greatest(adj, 1e-6)) - avg(ln(greatest(adj, 1e-6))) OVER (PARTITION BY run, period) AS clr_adj FROM shares),
vgrid AS (SELECT run, period, stratum, wref, aspect, coalesce(c.neg, 0) AS neg, coalesce(c.total, 0) AS total FROM (SELECT DISTINCT run, period FROM cells) JOIN vref USING (run) JOIN asp USING (run) LEFT JOIN cells c USING (run, period, stratum, aspect)),
vtot AS (SELECT *, sum(neg) OVER w / nullif(sum(total) OVER w, 0) AS nu0 FROM vgrid WINDOW w AS (PARTITION BY run, period, aspect)),
val AS (SELECT run, period, aspect, max(nu0) AS raw, sum(wref * (neg + 10.0e0 * nu0) / (total + 10.0e0)) / sum(wref) AS adj FROM vtot GROUP BY ALL),
obs AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY run, aspect, channel ORDER BY period) - 1 AS x, dense_rank() OVER (ORDER BY run, aspect, channel) AS series_id FROM ({series}) WHERE value IS NOT NULL),
perm AS (SELECT series_id, b, row_number() OVER (PARTITION BY series_id, b ORDER BY CASE WHEN b = 0 THEN lpad(CAST(x AS VARCHAR), 8, '0') ELSE md5(({seed}) || '|' || aspect || '|' || channel || '|' || b || '|' || x) END) - 1 AS x, value
  FROM obs CROSS JOIN (SELECT unnest(range({n_perm} + 1)) AS b)),
src AS MATERIALIZED (SELECT p.series_id, p.b, p.x, o.period, p.value FROM perm p JOIN obs o ON p.series_id = o.series_id AND p.x = o.x),
{STATS.replace("tr AS (", "tr AS MATERIALIZED (").replace("sp AS (", "sp AS MATERIALIZED (").replace("cen AS (", "cen AS MATERIALIZED (")},
pv AS (SELECT t.series_id, (count(*) FILTER (t.b > 0 AND abs(t.t_stat) >= abs(o.t_stat) - 1e-9) + 1) / ({n_perm} + 1) AS p_trend, (count(*) FILTER (t.b > 0 AND s.split_t >= os.split_t - 1e-9) + 1) / ({n_perm} + 1) AS p_split
  FROM tr t JOIN sp s USING (series_id, b) JOIN (SELECT * FROM tr WHERE b = 0) o ON o.series_id = t.series_id JOIN (SELECT * FROM sp WHERE b = 0) os ON os.series_id = t.series_id GROUP BY t.series_id),
pq AS (SELECT run, aspect, channel, round(tr.slope_per_year, 4) AS slope_per_year, round(tr.t_stat, 2) AS t_stat, sp.changepoint, round(sp.split_t, 2) AS split_t, round(p_trend, 5) AS p_perm, round(p_split, 5) AS p_perm_changepoint,
  CASE WHEN channel IN ('adj', 'val_adj') THEN 'adj' ELSE 'raw' END AS grid FROM (SELECT DISTINCT run, aspect, channel, series_id FROM obs) JOIN tr USING (series_id) JOIN sp USING (series_id, b) JOIN pv USING (series_id) WHERE b = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY run, grid ORDER BY p_perm, aspect, channel) AS k, count(*) OVER (PARTITION BY run, grid) AS m FROM pq),
qs AS (SELECT *, least(1, min(p_perm * m / k) OVER (PARTITION BY run, grid ORDER BY k DESC ROWS UNBOUNDED PRECEDING)) AS q_ FROM ranked),
sig AS (SELECT *, q_ <= {config.ALPHA} AS significant, CAST(round(CAST(round(q_, 9) AS DECIMAL(18, 9)), 5) AS DOUBLE) AS q FROM qs),
rep AS (SELECT *, {verdict("raw", "adj")} AS verdict, {verdict("val_raw", "val_adj")} AS verdict_val FROM sig)"""


REPORT = "aspect, channel, slope_per_year, t_stat, changepoint, split_t, p_perm, p_perm_changepoint, q, significant, verdict, verdict_val"


def poisson(u: str) -> str:
    """inference.poisson_times."""
    total, term, parts = 0.0, 2.718281828459045**-1, []
    for k in range(10):
        total += term
        term /= k + 1
        parts.append(f"CAST({u} >= {total!r} AS INT)")
    return " + ".join(parts)


def newton(k: int, steps: int = 14, prefix: str = "nr") -> str:
    """Tables up to {prefix}{steps}(b0..bk): the weights and intercept that fit data(f0..f(k-1), y, w), by Newton steps from 0."""
    n = range(k + 1)
    x = [f"f{i}" for i in range(k)] + ["1"]
    z = " + ".join(f"o{i} * {x[i]}" for i in n)
    out = [f"{prefix}0 AS (SELECT {', '.join(f'0.0e0 AS b{i}' for i in n)})"]
    for s in range(1, steps + 1):
        grads = ", ".join(f"sum(w * (p - y) * {x[i]}){f' + any_value(o{i})' if i < k else ''} AS g{i}" for i in n)
        bends = ", ".join(f"sum(w * p * (1 - p) * {x[i]} * {x[j]}){' + 1' if i == j < k else ''} AS h{i}_{j}" for i in n for j in range(i + 1))
        out.append(f"{prefix}g{s} AS MATERIALIZED (SELECT {', '.join(f'any_value(o{i}) AS o{i}' for i in n)}, {grads}, {bends} FROM (SELECT *, 1 / (1 + exp(-({z}))) AS p FROM data, (SELECT {', '.join(f'b{i} AS o{i}' for i in n)} FROM {prefix}{s - 1})))")
        # Cholesky, then both substitutions; a level of nesting for what needs the level before, so that nothing is written out twice.
        table = f"{prefix}g{s}"
        for j in n:
            rest = "".join(f" - l{j}_{m} * l{j}_{m}" for m in range(j))
            table = f"(SELECT *, sqrt(h{j}_{j}{rest} + 1e-12) AS l{j}_{j} FROM {table})"
            below = [f"(h{i}_{j}{''.join(f' - l{i}_{m} * l{j}_{m}' for m in range(j))}) / l{j}_{j} AS l{i}_{j}" for i in range(j + 1, k + 1)]
            table = f"(SELECT *, {', '.join(below)} FROM {table})" if below else table
        for i in n:
            table = f"(SELECT *, (g{i}{''.join(f' - l{i}_{m} * u{m}' for m in range(i))}) / l{i}_{i} AS u{i} FROM {table})"
        for i in reversed(n):
            table = f"(SELECT *, (u{i}{''.join(f' - l{m}_{i} * d{m}' for m in range(i + 1, k + 1))}) / l{i}_{i} AS d{i} FROM {table})"
        out.append(f"{prefix}{s} AS MATERIALIZED (SELECT {', '.join(f'o{i} - d{i} AS b{i}' for i in n)} FROM {table})")
    return ",\n".join(out)
