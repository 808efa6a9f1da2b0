"""Weighted cells of quads, reference compositions, and raw and standardised shares and valences."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aspectdrift import config


def rolled_up(quads: DataFrame, level: str = "taxonomy_code") -> DataFrame:
    """Adds aspect: the code where it is reportable, else its category; at level category always that."""
    code = F.when(F.col("reportable"), F.col("taxonomy_code")).otherwise(F.col("category")) if level == "taxonomy_code" else F.col("category")
    return quads.withColumn("aspect", code)


def with_taxonomy(quads: DataFrame, code_to_category: dict[str, str] | None = None, reportable: tuple[str, ...] = config.REPORTABLE) -> DataFrame:
    """Adds category (null outside the taxonomy) and reportable; the taxonomy is a constant of a few dozen rows."""
    table = code_to_category or config.code_to_category()
    pairs = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return quads.withColumn("category", F.try_element_at(pairs, F.col("taxonomy_code"))).withColumn("reportable", F.col("taxonomy_code").isin(*reportable))


def outside(quads: DataFrame) -> DataFrame:
    """(n, outside): quads, and those whose code isn't in the taxonomy, which cells() leaves out."""
    return quads.agg(F.count("*").alias("n"), F.count_if(F.col("category").isNull()).alias("outside"))


def weight(quads: DataFrame) -> Column:
    """w, else conf_seq, else 1; a column that the quads lack counts as null."""
    return F.coalesce(*[F.col(c) for c in ("w", "conf_seq") if c in quads.columns], F.lit(1.0))


def cells(quads: DataFrame, level: str = "taxonomy_code") -> DataFrame:
    """(period, stratum, aspect): total, neg and complaint weight. Weights of 0 and codes outside the taxonomy don't count.

    One map-side combined aggregation; everything later works on this table of periods x strata x aspects.
    """
    rows = quads.withColumn("__w", weight(quads)).where((F.col("__w") > 0) & F.col("category").isNotNull())
    negative, complaint = F.col("sentiment") == "negative", (F.col("phi") == "NEG") | (F.col("sentiment") == "negative")
    part = lambda c, name: F.sum(F.when(c, F.col("__w")).otherwise(0.0)).alias(name)
    return rolled_up(rows, level).groupBy("period", "stratum", "aspect").agg(
        F.sum("__w").alias("total"), part(negative, "neg"), part(complaint, "complaint"), F.count_if(complaint).alias("n_complaints"))


def complaints(cell: DataFrame) -> DataFrame:
    return cell.where("n_complaints > 0").select("period", "stratum", "aspect", F.col("complaint").alias("w"))


def collapsed(cell: DataFrame, least: float, other: str = "other") -> DataFrame:
    """cell with all strata of less than `least` weight in any period put into one."""
    small = cell.groupBy("stratum", "period").agg(F.sum("total").alias("t")).groupBy("stratum").agg((F.min("t") < least).alias("__small"))
    rows = cell.join(F.broadcast(small), "stratum").withColumn("stratum", F.when(F.col("__small"), other).otherwise(F.col("stratum")))  # a row a stratum
    return rows.groupBy("period", "stratum", "aspect").agg(*[F.sum(c).alias(c) for c in ("total", "neg", "complaint", "n_complaints")])


def reference(cell: DataFrame, column: str) -> DataFrame:
    """(stratum, wref): its share of all the weight in `column`."""
    rows = cell.groupBy("stratum").agg(F.sum(column).alias("w"))
    return rows.select("stratum", (F.col("w") / F.sum("w").over(Window.partitionBy())).alias("wref")).where("wref IS NOT NULL")


def grid(periods: DataFrame, ref: DataFrame, aspects: DataFrame) -> DataFrame:
    """All periods x strata x aspects: dimensions of a few dozen rows each."""
    return periods.crossJoin(ref).crossJoin(aspects)


def shares(pi_cells: DataFrame, ref: DataFrame, aspects: DataFrame, prior: float = config.PRIOR_SHARE) -> DataFrame:
    """(period, aspect, raw, adj) of complaint cells (period, stratum, aspect, w).

    raw is the pooled share; adj weighs every stratum's share by wref, each shrunk to the pooled share with
    strength `prior`, so a stratum without rows stays neutral.
    """
    full = grid(pi_cells.select("period").distinct(), ref, aspects).join(pi_cells, ["period", "stratum", "aspect"], "left").fillna({"w": 0.0})
    by = lambda *c: Window.partitionBy("period", *c)
    full = full.repartition("period").withColumn("n_st", F.sum("w").over(by("stratum"))).withColumn("pooled", F.sum("w").over(by("aspect")))
    strata = F.count(F.lit(1)).over(by("aspect"))  # the grid has every aspect once a stratum
    full = full.withColumn("all", F.sum("w").over(by())).withColumn("k", F.count(F.lit(1)).over(by()) / strata)
    s0 = F.when(F.col("all") > 0, F.col("pooled") / F.col("all")).otherwise(1.0 / F.col("k"))
    den = F.col("n_st") + F.lit(float(prior))
    share = F.when(den > 0, (F.col("w") + F.lit(float(prior)) * s0) / F.when(den > 0, den)).otherwise(s0)
    acc = full.groupBy("period", "aspect").agg(F.max("pooled").alias("raw"), F.sum(F.col("wref") * share).alias("adj"))
    unit = lambda c: F.col(c) / F.coalesce(F.nullif(F.sum(c).over(by()), F.lit(0.0)), F.lit(1.0))
    return acc.select("period", "aspect", unit("raw").alias("raw"), unit("adj").alias("adj"))


def valences(cell: DataFrame, ref: DataFrame, prior: float = config.PRIOR_VALENCE) -> DataFrame:
    """(period, aspect, raw, adj): share of negative weight; null where the aspect has no weight in the period."""
    nu_cells = cell.select("period", "stratum", "aspect", "neg", "total")
    full = grid(nu_cells.select("period").distinct(), ref, nu_cells.select("aspect").distinct()).join(nu_cells, ["period", "stratum", "aspect"], "left").fillna({"neg": 0.0, "total": 0.0})
    w = Window.partitionBy("period", "aspect")
    full = full.repartition("period").withColumn("neg0", F.sum("neg").over(w)).withColumn("tot0", F.sum("total").over(w))
    nu0 = F.col("neg0") / F.nullif(F.col("tot0"), F.lit(0.0))
    den = F.col("total") + F.lit(float(prior))
    nu = F.when(den > 0, (F.col("neg") + F.lit(float(prior)) * nu0) / F.when(den > 0, den)).otherwise(nu0)
    out = full.groupBy("period", "aspect").agg(F.max(nu0).alias("raw"), (F.sum(F.col("wref") * nu) / F.nullif(F.sum("wref"), F.lit(0.0))).alias("adj"))
    return out


def clr(rows: DataFrame, column: str, eps: float = 1e-6) -> DataFrame:
    """Adds clr_<column>: the centred log-ratio within the period."""
    log = F.ln(F.greatest(F.col(column), F.lit(eps)))
    return rows.withColumn(f"clr_{column}", log - F.avg(log).over(Window.partitionBy("period")))


def complaint_rows(quads: DataFrame, level: str = "taxonomy_code") -> DataFrame:
    """(period, stratum, review_uid, aspect, w): the quads that are complaints, one row each."""
    rows = quads.withColumn("__w", weight(quads)).where((F.col("__w") > 0) & F.col("category").isNotNull() & ((F.col("phi") == "NEG") | (F.col("sentiment") == "negative")))
    return rolled_up(rows, level).select("period", "stratum", "review_uid", "aspect", F.col("__w").alias("w"))


def review_vectors(quads: DataFrame, level: str = "taxonomy_code") -> DataFrame:
    """(period, stratum, review_uid, aspect, w): each review's complaint weight by aspect."""
    return complaint_rows(quads, level).groupBy("period", "stratum", "review_uid", "aspect").agg(F.sum("w").alias("w"))


def _hashed(batches):
    """Sorted rows (number, term) to (number, n, md5). Only the states of the hashes are held, and a batch's terms are hashed at once, as they lie in its buffer."""
    held = {}
    for b in batches:
        number, terms = b["number"].to_numpy(zero_copy_only=False), b["term"].cast(pa.large_binary())
        for g in np.unique(number):
            own = terms.filter(pa.array(number == g)) if number[0] != g or (number != g).any() else terms
            state = held.setdefault(int(g), [0, hashlib.md5()])
            ends = np.frombuffer(own.buffers()[1], np.int64)[own.offset : own.offset + len(own) + 1]
            state[1].update(memoryview(own.buffers()[2])[ends[0] + (state[0] == 0) : ends[-1]])  # without the first separator
            state[0] += len(own)
    if held:
        yield pa.RecordBatch.from_pydict({"number": pa.array(list(held), pa.int32()), "n": pa.array([n for n, _ in held.values()], pa.int64()), "md5": [h.hexdigest() for _, h in held.values()]})


def joined_md5(rows: DataFrame, groups: int, order: list[str], term: Column) -> DataFrame:
    """(number, n, md5) of groups 0 to groups - 1: rows, and the md5 of their terms joined by semicolons in the given order.

    For few and large groups: a task sorts one, which may spill, and hashes it as it streams by, so no group is held whole.
    """
    sorted_rows = rows.withColumn("number", F.col("number").cast("int")).repartitionById(groups, F.col("number")).sortWithinPartitions(*order)
    return sorted_rows.select("number", F.concat(F.lit(";"), term).alias("term")).mapInArrow(_hashed, "number int, n long, md5 string")
