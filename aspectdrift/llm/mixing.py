"""Mixing sources to target weights by pivotal dependent rounding.

A document of a source is wanted x = target / source_size times: floor(x) copies for certain and one
more with probability x - floor(x). Those fractions are rounded dependently: two documents meet, word
mass moves from one to the other, in a direction drawn so that neither's expected copies change, until
one of them has 0 or 1 extra copies; the other goes on to meet the next. Mass is counted in words, so a
meeting keeps the source's words as they are, and only the one document left of a source changes
them when it is rounded at last. Small documents are kept back to meet what the large ones leave all
together, so the one left is small wherever a source has small ones enough.

The meetings form a tree: blocks of about `block_rows` documents dealt by a hash of the id,
then FAN residuals of blocks at a time. Block numbers
and draws depend on ids alone, so reruns agree under any partitioning; a hot source has more blocks.

Defined results: null text has size 0; documents of size 0 take 0 words and, in mixed(), 0 copies;
a null source is a source of its own that sorts last; rows with the same id meet and are drawn alike
but are rounded one by one; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aspectdrift.llm.common import staged

WEIGHTS = (5.0, 2.0, 1.0)
MOST = 3.0
FAN = 512
_EPS = 1e-9
_MASK = (1 << 64) - 1


def words(text: str) -> Column:
    """Number of runs of anything but space, tab, line feed, vertical tab, form feed, carriage return."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """sizes(source, source_size) -> (source, source_size, target). One row a source, so windows over all are small.

    Sharing the excess by weight until no target is above `most` times its source's size fills all
    sources to one common level of target per weight, save those that stop at their limit before: with
    sources in order of limit per weight, the level comes from the first one that doesn't stop.
    """
    n = len(weights)
    by_point = Window.orderBy(F.col("source").isNull(), F.col("source"))
    w = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(by_point) - 1, F.lit(n)) + 1).cast("int"))
    rows = sizes.withColumn("w", w).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    order = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").isNull(), F.col("source"))
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    total = F.sum("source_size").over(Window.partitionBy())
    level = (total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(after)
    # After the source where the level comes from, later ones would only give a lower level.
    rows = rows.withColumn("own", F.when(level * F.col("w") <= F.col("cap"), level))
    rows = rows.withColumn("level", F.max("own").over(Window.partitionBy()))
    return rows.select("source", "source_size", F.least(F.col("cap"), F.col("level") * F.col("w")).alias("target"))


def _u(seed: int, a: int, b: int) -> float:
    """A number in [0, 1) from two row hashes."""
    x = (a * 0x9E3779B97F4A7C15 + b * 0xC2B2AE3D27D4EB4F + seed * 0x165667B19E3779F9 + 0x27D4EB2F165667C5) & _MASK
    x ^= x >> 30
    x = x * 0xBF58476D1CE4E5B9 & _MASK
    x ^= x >> 27
    x = x * 0x94D049BB133111EB & _MASK
    return ((x ^ (x >> 31)) >> 11) / (1 << 53)


def _open(f: float) -> bool:
    return _EPS < f < 1 - _EPS


def meet(rows: list[tuple[int, int, float]], seed: int) -> tuple[list[int], list[float]]:
    """Round (key, size, fraction), largest sizes first; returns each one's extra copies, and its fraction if it is the
    one left (else -1). Rows that are integral already stay out.

    Enough of the smallest are kept back to take up whatever the others leave: the others meet one after
    another, and the one left of them meets those kept back at once, each taking or giving its share, so
    that it settles and only small ones stay open. These go on alike. What is larger than all below it
    could take up meets last.
    """
    size, f = [r[1] for r in rows], [r[2] for r in rows]

    def chain(some: list[int]) -> int | None:
        """Two meet, words move until one is settled, the other goes on to meet the next."""
        held = None
        for i in some:
            if held is None:
                held = i if _open(f[i]) else None
                continue
            up = min((1 - f[held]) * size[held], f[i] * size[i])  # words that the one held can gain from this one
            down = min(f[held] * size[held], (1 - f[i]) * size[i])
            d = up if _u(seed, rows[held][0], rows[i][0]) * (up + down) < down else -down
            f[held], f[i] = f[held] + d / size[held], f[i] - d / size[i]
            held = i if _open(f[i]) else held if _open(f[held]) else None
        return held

    def settle(held: int, back: list[int]) -> bool:
        """The one held goes to 0 or 1; each partner's share of the words fits both ways, so its expected copies stay."""
        up, down, rest, shares = (1 - f[held]) * size[held], f[held] * size[held], 1.0, []
        for j in back:
            share = min(f[j] * size[j] / up, (1 - f[j]) * size[j] / down, rest)
            shares.append((j, share))
            rest -= share
            if rest <= 1e-12:
                break
        if rest > 1e-9:
            return False
        rises = _u(seed, rows[held][0], rows[back[0]][0]) < f[held]
        for j, share in shares:
            f[j] += (-up if rises else down) * share / size[j]
        f[held] = float(rises)
        return True

    live, last = [i for i in range(len(rows)) if _open(f[i])], []
    while len(live) > 1:
        room = [0.0]  # words that the k smallest could take or give in any case
        for i in reversed(live):
            room.append(room[-1] + min(f[i], 1 - f[i]) * size[i])
        first = 0
        while first < len(live) and room[len(live) - first - 1] < size[live[first]]:
            first += 1
        last += live[:first]
        live = live[first:]
        if not live:
            break
        kept = bisect_left(room, size[live[0]], hi=len(live))
        front, back = live[:-kept], live[-kept:]
        held = chain(front)
        if held is not None and not settle(held, back):
            last.append(held)
        live = [i for i in back if _open(f[i])]
    held = chain(last + live)
    left = [-1.0] * len(rows)
    if held is not None:
        left[held] = f[held]
    return [0 if i == held else round(x) for i, x in enumerate(f)], left


def _round(seed: int, final: bool):
    """For applyInArrow: rows (…, key, size, p) of a group get extra and left; with final none is left."""

    def run(group: pa.Table) -> pa.Table:
        key = [k & _MASK for k in group["key"].to_pylist()]
        size, p = group["size"].to_pylist(), group["p"].to_pylist()
        order = sorted(range(len(key)), key=lambda i: (-size[i], key[i]))
        some, rest = meet([(key[i], size[i], p[i]) for i in order], seed)
        extra, left = [0] * len(key), [-1.0] * len(key)
        for i, e, x in zip(order, some, rest, strict=True):
            extra[i], left[i] = (int(_u(seed + 1, key[i], 0) < x), -1.0) if final and x >= 0 else (e, x)
        return group.append_column("extra", pa.array(extra, pa.int64())).append_column("left", pa.array(left, pa.float64()))

    return run


def copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 7, block_rows: int = 4096) -> DataFrame:
    """One row a document: id, source, size, source_size, target, copies (0 to MOST)."""
    base = staged(docs.select(F.col(id_col).cast("long").alias("id"), F.col(source_col).cast("string").alias("source"), words(text_col).alias("size")))
    sums = staged(base.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs")))
    plan = targets(sums).withColumnRenamed("source", "s")
    most = sums.agg(F.max(F.ceil(F.col("docs") / block_rows))).first()[0] or 1
    counts = sums.select(F.col("source").alias("s2"), F.ceil(F.col("docs") / block_rows).alias("blocks"))
    plan = plan.join(counts, F.col("s").eqNullSafe(F.col("s2"))).drop("s2")
    x = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    wide = base.join(plan, F.col("source").eqNullSafe(F.col("s"))).withColumn("x", x).withColumn("whole", F.floor(F.col("x") + F.lit(_EPS)).cast("long"))
    wide = wide.select(
        "id", "source", "size", "source_size", "target", F.when(F.col("size") > 0, F.col("whole")).otherwise(F.lit(0)).cast("long").alias("whole"),
        F.xxhash64("id", F.lit(seed)).alias("key"), F.pmod(F.xxhash64("id", F.lit(seed + 1)), F.col("blocks")).alias("block"),
        F.when(F.col("size") > 0, F.greatest(F.col("x") - F.col("whole"), F.lit(0.0))).otherwise(F.lit(0.0)).alias("p"),
    )
    kinds = "source string, size long, key long, block long, p double, extra long, left double"
    leaf = staged(wide.groupBy("source", "block").applyInArrow(_round(seed, False), f"id long, source string, size long, source_size long, target double, whole long, {kinds.split(', ', 2)[2]}"))
    settled, open_rows, span, levels = None, leaf.where("left >= 0").select("source", "size", "key", "block", F.col("left").alias("p")), FAN, 1
    while True:
        final = span >= most
        met = open_rows.withColumn("at", F.floor(F.col("block") / F.lit(span)).cast("long")).groupBy("source", "at").applyInArrow(
            _round(seed + 2 * levels, final), f"source string, size long, key long, block long, p double, at long, {kinds.split(', ', 5)[5]}")
        met = staged(met)
        done = met.where("left < 0").select("source", "block", F.col("extra").alias("late"))
        settled = done if settled is None else settled.unionByName(done)
        if final:
            break
        open_rows = met.where("left >= 0").select("source", "size", "key", "block", F.col("left").alias("p"))
        span, levels = span * FAN, levels + 1
    # A leaf block leaves one document at most, so source and block name it.
    settled = settled.select(F.col("source").alias("s"), F.col("block").alias("b"), "late")
    last = leaf.where("left >= 0").join(settled, F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b")))
    cols = ["id", "source", "size", "source_size", "target"]
    return leaf.where("left < 0").select(*cols, (F.col("whole") + F.col("extra")).alias("copies")).unionByName(last.select(*cols, (F.col("whole") + F.col("late")).alias("copies")))


def op2(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken of all documents, with the source and its copies."""
    return copies(docs).select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The documents themselves, each as often as the mix takes it. Rows that share an id get its most copies."""
    take = copies(docs, id_col, text_col, source_col).groupBy("id").agg(F.max("copies").alias("__copies")).where("__copies > 0")
    many = docs.join(take.withColumnRenamed("id", "__id"), F.col(id_col).cast("long").eqNullSafe(F.col("__id")))
    return many.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select(*[docs[c] for c in docs.columns])
