"""Permutation tests, bootstrap intervals, false-discovery control and verdicts."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aspectdrift import config
from aspectdrift.operators import aggregate, series
from aspectdrift.sources.scratch import staged


def _statistics(y: np.ndarray, months: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """|trend t| and best split |t| of each row of y (permutations x points), deseasonalised by its months."""
    n = y.shape[1]
    hot = (months[:, None] == np.unique(months)[None]).astype(float)
    y = y - (y @ hot / hot.sum(axis=0)) @ hot.T + y.mean(axis=1, keepdims=True)
    y = y - y.mean(axis=1, keepdims=True)
    dx = np.arange(n) - (n - 1) / 2
    sxx = (dx * dx).sum()
    b = y @ dx / sxx
    rest = y - b[:, None] * dx
    se = np.sqrt((rest * rest).sum(axis=1) / (n - 2) / sxx)
    trend = np.divide(np.abs(b), se, out=np.zeros_like(b), where=se > 0)
    i = np.arange(4, n - 4)
    sl, ql = np.cumsum(y, axis=1)[:, i - 1], np.cumsum(y * y, axis=1)[:, i - 1]
    s, q = y.sum(axis=1, keepdims=True), (y * y).sum(axis=1, keepdims=True)
    va, vb = np.maximum(ql - sl * sl / i, 0) / (i - 1), np.maximum(q - ql - (s - sl) ** 2 / (n - i), 0) / (n - i - 1)
    den = np.sqrt(va / i + vb / (n - i))
    t = np.divide(np.abs(sl / i - (s - sl) / (n - i)), den, out=np.zeros_like(den), where=den > 0)
    return trend, t.max(axis=1, initial=0.0)


def permutation_p(rows: DataFrame, n_perm: int = config.PERMUTATIONS, seed: int = config.SEED) -> DataFrame:
    """(series_id, p_trend, p_split) of series (series_id, period, value); series under 12 points are left out.

    Permutation b puts the values in the order of md5(seed|series|b|place); a series' draws depend on its
    own name alone. All permutations of a series are one matrix; a group is as long as a series.
    """

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.dropna(subset=["value"]).sort_values("period")
        name, n = group["series_id"].iloc[0] if len(group) else "", len(group)
        if n < series.LEAST_POINTS:
            return pd.DataFrame({"series_id": [], "p_trend": [], "p_split": []})
        y, months = group["value"].to_numpy(float), group["period"].str[5:7].to_numpy()
        draws = [sorted(range(n), key=[hashlib.md5(f"{seed}|{name}|{b}|{x}".encode()).hexdigest() for x in range(n)].__getitem__) for b in range(1, n_perm + 1)]
        trend, split = _statistics(np.vstack([y[None], y[np.array(draws, int).reshape(-1, n)]]), months)
        # Sums in another order differ in the last digits; an equal statistic counts as reached.
        hit = lambda s: float(((s[1:] >= s[0] - 1e-9).sum() + 1) / (n_perm + 1))
        return pd.DataFrame({"series_id": [name], "p_trend": [hit(trend)], "p_split": [hit(split)]})

    return rows.select("series_id", "period", "value").groupBy("series_id").applyInPandas(run, "series_id string, p_trend double, p_split double")


def _poisson_steps() -> list[float]:
    """A uniform number gives as many as it reaches of these."""
    total, term, steps = 0.0, math.exp(-1), []
    for k in range(10):
        total += term
        term /= k + 1
        steps.append(total)
    return steps


def poisson_times(u: Column) -> Column:
    """How often a row counts in a replicate: a Poisson draw of mean 1 from a uniform number."""
    return reduce(Column.__add__, [(u >= s).cast("int") for s in _poisson_steps()])


def poisson_counts(bits: np.ndarray) -> np.ndarray:
    """poisson_times of 32 bits each, exactly as of bits / 2^32."""
    times = np.zeros(bits.shape, np.uint8)
    for s in _poisson_steps():
        times += bits >= math.ceil(s * (1 << 32))
    return times


#: So many numbers a task holds at once: rows x replicates at work, cells x replicates summed up.
AT_ONCE, HELD = 1 << 21, 1 << 23


def _drawn(batches: Iterator[pa.RecordBatch], replicates: int, seed: int) -> Iterator[pa.RecordBatch]:
    """Rows (period, stratum, aspect, review_uid, w) to cells with a sum for each replicate; a cell may come several times."""
    cells, sums, most = {}, np.zeros((0, replicates)), max(HELD // replicates, 1)
    heads = [f"{seed}|{four}".encode() for four in range((replicates + 3) // 4)]

    def times(uids: list[str | None]) -> np.ndarray:
        tails = [b"" if u is None else b"|" + u.encode() for u in uids]
        bits = np.frombuffer(b"".join([hashlib.md5(head + tail).digest() for tail in tails for head in heads]), ">u4").reshape(len(uids), -1)
        return poisson_counts(bits[:, :replicates].astype(np.uint32))

    def out() -> Iterator[pa.RecordBatch]:
        keys = list(cells)
        for at in range(0, len(keys), step := max(AT_ONCE // replicates, 1)):
            part = keys[at:at + step]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1) * replicates, pa.int32()), pa.array(sums[at:at + len(part)].reshape(-1)))
            yield pa.RecordBatch.from_arrays([*(pa.array([k[i] for k in part], pa.string()) for i in range(3)), lists], ["period", "stratum", "aspect", "sums"])

    for whole in batches:
        for at in range(0, whole.num_rows, step := max(AT_ONCE // replicates, 1)):
            batch = whole.slice(at, step)
            keys = [c.dictionary_encode("encode") for c in batch.columns[:3]]
            flat, names = np.zeros(batch.num_rows, np.int64), [k.dictionary.to_pylist() for k in keys]
            for k, n in zip(keys, names, strict=True):
                flat = flat * len(n) + k.indices.to_numpy()
            order = np.argsort(flat, kind="stable")
            found, first = np.unique(flat[order], return_index=True)
            a, b, c = found // (len(names[1]) * len(names[2])), found // len(names[2]) % len(names[1]), found % len(names[2])
            places = [cells.setdefault((names[0][x], names[1][y], names[2][z]), len(cells)) for x, y, z in zip(a, b, c, strict=True)]
            if len(cells) > len(sums):
                sums = np.vstack([sums, np.zeros((max(len(cells), min(2 * len(sums), most)) - len(sums), replicates))])
            reviews = batch.column(3).dictionary_encode("encode")
            counts, w = times(reviews.dictionary.to_pylist())[reviews.indices.to_numpy()[order]], batch.column(4).to_numpy(zero_copy_only=False)[order]
            sums[places] += np.add.reduceat(counts * w[:, None], first, axis=0)
            if len(cells) >= most:
                yield from out()
                cells, sums = {}, np.zeros((0, replicates))
    yield from out()


def bootstrap_shares(vectors: DataFrame, ref: DataFrame, aspects: DataFrame, replicates: int, seed: int = config.SEED, prior: float = config.PRIOR_SHARE) -> DataFrame:
    """(b, period, aspect, adj): adjusted shares with reviews redrawn within period and stratum.

    vectors(period, stratum, review_uid, aspect, w), in any number of rows a review and aspect. Every review of a cell
    counts as often as a Poisson draw of its own says, which is drawing with replacement without fixing the cell's total;
    all aspects share a review's draw. Draws are parts of a hash of seed, every four replicates and review, made where the
    row lies, for all replicates at once, and summed to cells before anything moves: only replicates x cells are shuffled,
    and written once.
    """
    keys = ["period", "stratum", "aspect"]
    rows = vectors.select(*[F.col(k).cast("string") for k in (*keys, "review_uid")], F.col("w").cast("double"))
    drawn = rows.mapInArrow(lambda batches: _drawn(batches, replicates, seed), "period string, stratum string, aspect string, sums array<double>")
    drawn = drawn.repartition(*keys).select(*keys, F.posexplode("sums").alias("b", "w")).where("w <> 0")
    # A replicate is one more level of the period, so the shares of all replicates are one plan.
    one = staged(drawn.groupBy(*keys, "b").agg(F.sum("w").alias("w")).withColumn("period", F.concat_ws("#", "period", F.col("b") + 1)).drop("b"))
    parts = F.split("period", "#")
    return aggregate.shares(one, ref, aspects, prior).select(parts[1].cast("int").alias("b"), parts[0].alias("period"), "aspect", "adj")


def bootstrap_slopes(vectors: DataFrame, ref: DataFrame, aspects: DataFrame, replicates: int, seed: int = config.SEED, prior: float = config.PRIOR_SHARE) -> DataFrame:
    """(b, aspect, slope): slopes of the log-ratios of bootstrap_shares."""
    drawn = bootstrap_shares(vectors, ref, aspects, replicates, seed, prior).select(F.concat_ws("#", "period", "b").alias("period"), "aspect", "adj")
    logs = aggregate.clr(drawn, "adj")
    parts = F.split("period", "#")
    rows = logs.select(F.concat_ws("#", "aspect", parts[1]).alias("series_id"), parts[0].alias("period"), F.col("clr_adj").alias("value"))
    slopes = series.trend(series.deseason(series.points(rows, 1)))
    name = F.split("series_id", "#")
    return slopes.select(name[1].cast("int").alias("b"), name[0].alias("aspect"), F.col("slope_per_year").alias("slope"))


def interval(rows: DataFrame, low: float = 0.025, high: float = 0.975, value: str = "slope", by: tuple[str, ...] = ("aspect",)) -> DataFrame:
    """(by..., lo, hi): the sorted values at places floor(p n). A group has one row a replicate."""
    sorted_ = rows.groupBy(*by).agg(F.sort_array(F.collect_list(value)).alias("s"))
    at = lambda p: F.element_at("s", F.floor(F.lit(p) * F.size("s")).cast("int") + 1)
    return sorted_.select(*by, at(low).alias("lo"), at(high).alias("hi"))


def fdr(rows: DataFrame, p: str = "p", grid: str = "grid") -> DataFrame:
    """Adds q, the Benjamini-Hochberg value within each grid. A grid has a few rows an aspect."""
    w = Window.partitionBy(grid)
    rank = F.row_number().over(w.orderBy(p, *[c for c in rows.columns if c != p]))
    rows = rows.withColumn("__rank", rank).withColumn("__ratio", F.col(p) * F.count("*").over(w) / F.col("__rank"))
    least = F.min("__ratio").over(w.orderBy(F.col("__rank").desc()).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("q", F.least(least, F.lit(1.0))).drop("__rank", "__ratio")


def diagnostics(m: int, n_perm: int, alpha: float = config.ALPHA) -> dict[str, float | int | bool]:
    """What a grid of m hypotheses can show at this number of permutations."""
    floor = 1.0 / (n_perm + 1)
    return {
        "grid_size": m, "p_floor": floor, "n_perm_min": max(math.ceil(m / alpha) - 1, 0) if m else 0,
        "single_effect_reachable": bool(m) and floor * m <= alpha, "min_simultaneous": math.ceil(floor * m / alpha) if m else 0,
        "margin": n_perm / max(math.ceil(m / alpha) - 1, 1) if m else math.inf,
    }


def diagnostic_columns(m: Column, n_perm: int, alpha: float = config.ALPHA) -> list[Column]:
    """The same of a column of grid sizes."""
    floor = 1.0 / (n_perm + 1)
    return [
        m.cast("long").alias("grid_size"), F.lit(floor).alias("p_floor"), F.greatest(F.ceil(m / alpha) - 1, F.lit(0)).cast("long").alias("n_perm_min"),
        ((m > 0) & (floor * m <= alpha)).alias("single_effect_reachable"), F.ceil(floor * m / alpha).cast("long").alias("min_simultaneous"),
    ]


def verdict_counts(report: DataFrame) -> DataFrame:
    """(verdict, n): aspects by the verdict on their shares."""
    return report.select("aspect", "verdict").distinct().groupBy("verdict").agg(F.count("*").alias("n"))


def verdict(raw_significant: Column, adj_significant: Column, raw_slope: Column, adj_slope: Column) -> Column:
    """From both tests and the slopes as reported: REAL, SPURIOUS, MASKED, SIGN_FLIP, UNDETERMINED or FLAT."""
    raw, adj = F.coalesce(raw_significant, F.lit(False)), F.coalesce(adj_significant, F.lit(False))
    sign = F.coalesce(raw_slope * adj_slope, F.lit(0.0))
    return F.when(adj & raw & (sign > 0), "REAL").when(raw & ~adj, "SPURIOUS").when(adj & ~raw, "MASKED").when(adj & raw & (sign < 0), "SIGN_FLIP").when(adj, "UNDETERMINED").otherwise("FLAT")
