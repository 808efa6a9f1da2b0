"""Embedding near-duplicates by iterative quantisation and multi-index Hamming tables.

Fit, on a bounded sample: principal axes, and rotations of them that bring signs near the projections
(iterative quantisation), which spreads the variance evenly over the bits. Vectors are not centred: bits
then differ in proportion to the angle that the cosine means, also where all vectors lie to one side, where
centred codes lose most links (the tests measure it). Every vector gets a code of the signs under all rotations.

Retrieval: disjoint substrings of the codes are indexed; every code is entered under its own substring and
under those one flip away, so codes that differ in up to two bits of any substring meet. The width of a
substring follows the number of vectors and how often sampled ones meet, so cells keep their size as the
table grows, and there are as many tables as find a pair at the threshold with probability RECALL. Of all cells where two codes meet, one
that both can tell counts, so no pair is ever listed or counted twice. A cell gives its members that met
another one within `reach` of the whole code; a crowded cell gives all of them.

Rerank: members fetch their original vectors, and each cell compares those that count in it by cosine in
double precision, in pairs of blocks of `block` vectors; only counts and forests leave a block.

Hot groups: a few sampled leaders are compared with everybody. Vectors within half the threshold's angle of
one leader are linked with each other for certain, so a group of more than `block` of them is counted
without looking at pairs; only what lies within reach of such a ball is compared with its members.
Equal vectors are one node.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components link with
nothing; vectors of different lengths don't link with each other, each length is indexed by itself (one
plan a length, so lengths should be few); rows with a null id are answered (no links, null component)
but link with nothing; repeated rows count one by one; an empty table gives no rows; extra columns,
labels too, are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aspectdrift.llm.common import Labels, cells_of, components, hash_key, smallest, staged

SAMPLE_ROWS, LEADERS = 8192, 1024
#: How often the tables are to find a pair at the threshold; what comparing a pair costs beside entering a code.
RECALL, MEETING = 0.99, 0.05
LINKS = "node long, other long, weight long"


@dataclass
class Quantiser:
    """Codes are the signs of x / |x| @ axes, a column a bit."""

    axes: np.ndarray

    def codes(self, x: np.ndarray) -> np.ndarray:
        """Rows of 64-bit words."""
        bits = x / np.linalg.norm(x, axis=1, keepdims=True) @ self.axes > 0
        bits = np.pad(bits, ((0, 0), (0, -bits.shape[1] % 64)))
        return np.packbits(bits, axis=1, bitorder="little").view(np.uint64)


def fit(sample: np.ndarray, bits: int = 256, rounds: int = 30, seed: int = 5) -> Quantiser:
    x = sample / np.linalg.norm(sample, axis=1, keepdims=True)
    _, axes = np.linalg.eigh(x.T @ x)
    v = x @ axes
    rng, turns = np.random.default_rng(seed), []
    for _ in range(max(1, -(-bits // x.shape[1]))):
        r = np.linalg.qr(rng.standard_normal((x.shape[1],) * 2))[0]
        for _ in range(rounds):
            u, _, w = np.linalg.svd(v.T @ np.where(v @ r > 0, 1.0, -1.0))
            r = u @ w
        turns.append(axes @ r)
    return Quantiser(np.concatenate(turns, axis=1))


def nodes(vectors: DataFrame, id_col: str, vec_col: str) -> tuple[DataFrame, DataFrame]:
    """Rows (vec_id, node) of all vectors, node null where it can't link, and (node, low, n, x) of distinct vectors."""
    x = F.col(vec_col).cast("array<double>")
    sound = F.col(id_col).isNotNull() & x.isNotNull() & ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))) & F.exists(x, lambda c: c != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.when(F.coalesce(sound, F.lit(False)), x).alias("x"))
    distinct = rows.where("x IS NOT NULL").groupBy("x").agg(F.min("vec_id").alias("low"), F.count("*").alias("n"))
    distinct = staged(distinct.withColumn("node", F.monotonically_increasing_id()))
    joined = rows.where("x IS NOT NULL").join(distinct.select("x", "node"), "x").select("vec_id", "node")
    return joined.unionByName(rows.where("x IS NULL").select("vec_id", F.lit(None).cast("long").alias("node"))), distinct


@dataclass
class Index:
    """Tables of `bits` bits, `per` of them in a 64-bit word of a code."""

    bits: int
    per: int
    tables: int

    def words(self) -> int:
        return -(-self.tables // self.per)

    def part(self, code: np.ndarray, t: int) -> np.ndarray:
        return (code[..., t // self.per] >> np.uint64(self.bits * (t % self.per))) & np.uint64((1 << self.bits) - 1)

    def counts_here(self, x: np.ndarray, y: np.ndarray, t: np.ndarray, key: np.ndarray) -> np.ndarray:
        """Whether codes x and y meet in cell (t, key) and that cell is the one that counts.

        It is in the first table where they differ in at most two bits, and of the cells that they share there
        their own one if they agree, else the smaller of two.
        """
        shape = np.broadcast_shapes(x.shape[:-1], y.shape[:-1])
        t, key, out, open_ = np.broadcast_to(t, shape), np.broadcast_to(key, shape), np.zeros(shape, bool), np.ones(shape, bool)
        for k in range(self.tables):
            a = self.part(x, k)
            diff = a ^ self.part(y, k)
            n = np.bitwise_count(diff)
            here = open_ & (n <= 2)
            if (own := here & (t == k)).any():
                low = diff & (~diff + np.uint64(1))
                first = np.where(n == 2, np.minimum(a ^ low, a ^ diff ^ low), np.minimum(a, a ^ diff))
                out |= own & (first == key)
            open_ = open_ & ~here
            if not (open_ & (t > k)).any():
                break
        return out


def tables_for(bits: int, threshold: float) -> int:
    """As many as find a pair at the threshold, two bits of a substring being free, with probability RECALL."""
    p = math.acos(min(1.0, max(-1.0, threshold))) / math.pi
    found = sum(math.comb(bits, k) * p**k * (1 - p) ** (bits - k) for k in range(3))
    return max(1, math.ceil(math.log(1 - RECALL) / math.log(max(1 - found, 1e-9))))


def index_for(rows: int, threshold: float, codes: np.ndarray) -> Index:
    """The width that makes entering codes and comparing those that meet cheapest for so many vectors.

    How often two vectors meet is measured on the codes of a sample, so clustered vectors get wider keys; as rows
    grow the width grows about like their log2, and cells keep their size. Comparing costs MEETING of an entry.
    """
    one, two = codes[: len(codes) // 2, 0], codes[len(codes) // 2 : len(codes) // 2 * 2, 0]
    diff = one[:512, None] ^ two[None, :2048]
    best = None
    for bits in range(8, 33):
        tables = tables_for(bits, threshold)
        near = np.bitwise_count(diff & np.uint64((1 << bits) - 1)) <= 2
        met = max(near.mean(), 0.5 / max(diff.size, 1)) if near.size else 0.0
        cost = tables * (bits + 1 + MEETING * rows * met)
        if best is None or cost < best[0]:
            best = cost, Index(bits, 64 // bits, tables)
    return best[1]


def _unit(column: pa.Array | np.ndarray) -> np.ndarray:
    items = column.to_numpy(zero_copy_only=False) if isinstance(column, pa.Array) else column
    x = np.stack(items).astype(float) if len(items) else np.empty((0, 1))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _angles(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(x @ y.T, -1.0, 1.0))


def _coded(model: Quantiser, leaders: np.ndarray, radius: float):
    """Columns node, x -> node, the code's words, ball (the nearest leader within radius, else null) and angle to it."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _unit(batch.column(1))
            words = model.codes(x).view(np.int64)
            ball, angle = np.zeros(len(x), np.int64), np.zeros(len(x))
            for lo in range(0, len(x), 2048):  # so many rows by LEADERS numbers at a time
                near = x[lo : lo + 2048] @ leaders.T
                ball[lo : lo + 2048] = best = near.argmax(axis=1)
                angle[lo : lo + 2048] = np.arccos(np.clip(near[np.arange(len(near)), best], -1.0, 1.0))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(np.ascontiguousarray(w)) for w in words.T), pa.array(ball, pa.int64(), mask=angle > radius), pa.array(angle)],
                names=["node", *(f"w{i}" for i in range(words.shape[1])), "ball", "angle"])

    return run


def _near_balls(numbers: np.ndarray, leaders: np.ndarray, reach: np.ndarray):
    """Columns node, n, x, ball -> (hot, outer, node, n, x): members of hot balls, and for each ball what lies within its reach.

    Of two hot balls the one with the smaller number has the other's members as outer ones.
    """

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            own = batch.column(3).fill_null(-1).to_numpy(zero_copy_only=False)
            inside = own[:, None] == numbers
            outer = (_angles(_unit(batch.column(2)), leaders) <= reach) & ~inside & ~(np.isin(own, numbers)[:, None] & (own[:, None] < numbers))
            row, at = np.nonzero(inside | outer)
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [pa.array(numbers[at]), pa.array(outer[row, at].astype(np.int32)), *(batch.column(i).take(take) for i in range(3))], names=["hot", "outer", "node", "n", "x"])

    return run


def _linked(node: np.ndarray, n: np.ndarray, hits) -> pa.RecordBatch:
    """Rows (node, other, weight) of a cell: how many rows a node's links stand for, and a node it is joined with or null.

    hits(lo, hi) gives the links of members lo to hi with all members.
    """
    labels, weight, step = Labels(len(node)), np.zeros(len(node), np.int64), max(16, (1 << 20) // len(node))
    for lo in range(0, len(node), step):
        hit = hits(lo, min(lo + step, len(node)))
        hit[np.arange(len(hit)), lo + np.arange(len(hit))] = False
        weight[lo : lo + step] = hit @ n
        labels.join_rows(lo, hit)
    own = np.flatnonzero(weight)
    other = labels.label[own]
    return pa.RecordBatch.from_arrays([pa.array(node[own]), pa.array(node[other], mask=other == own), pa.array(weight[own])], names=["node", "other", "weight"])


def _across(threshold: float):
    """Rows (hot, i, j, outer, node, n, x) sorted by the first three: links between members and outer ones."""

    def run(batches):
        for (_, _, _, outer, node, n, x), at in cells_of(batches, 3, 1 << 62, 0):
            own = at[0]
            v, side = _unit(x[own]), outer[own]
            if len(np.unique(side)) == 2:
                yield _linked(node[own], n[own], lambda lo, hi, v=v, side=side: (v[lo:hi] @ v.T >= threshold) & (side[lo:hi, None] != side))

    return run


def _meet(index: Index, limit: int, most: int):
    """Rows (t, key, node, words...) sorted by t and key: those that met another within limit, all of crowded cells."""

    def run(batches):
        for (t, key, node, *words), at in cells_of(batches, 2, most, 64):
            if at is None:
                hit = np.arange(len(node))
            else:
                code, m = np.stack(words, axis=1).view(np.uint64), at.shape[1]
                met, step = np.zeros(at.shape, bool), max(1, (1 << 18) // at.size)
                for lo in range(0, m - 1, step):
                    own = at[:, lo : lo + step]
                    n = sum(np.bitwise_count(w[own][:, :, None] ^ w[at][:, None, lo + 1 :]).astype(np.uint16) for w in code.T)
                    g, i, j = np.nonzero((n <= limit) & np.tri(m - lo - 1, own.shape[1], 0, dtype=bool).T)
                    i, j = i + lo, j + lo + 1
                    counts = index.counts_here(code[at[g, i]], code[at[g, j]], t[at[g, i]], key.view(np.uint64)[at[g, i]])
                    met[g[counts], i[counts]] = met[g[counts], j[counts]] = True
                hit = at[met]
            yield pa.RecordBatch.from_arrays([pa.array(t[hit]), pa.array(key[hit]), pa.array(node[hit])], names=["t", "key", "node"])

    return run


def _rerank(index: Index, threshold: float):
    """Rows (t, key, i, j, side, node, n, x, words...) sorted by the first four: links that count in their cell."""

    def run(batches):
        for (t, key, i, j, side, node, n, x, *words), at in cells_of(batches, 4, 1 << 62, 8):
            code = np.stack(words, axis=1).view(np.uint64)
            if len(at) > 1:  # small cells of one size, in one block each
                v = _unit(x[at.ravel()]).reshape(*at.shape, -1)
                g, a, b = np.nonzero((v @ v.transpose(0, 2, 1) >= threshold) & np.tri(at.shape[1], k=-1, dtype=bool))
                counts = index.counts_here(code[at[g, a]], code[at[g, b]], t[at[g, a]], key.view(np.uint64)[at[g, a]])
                a, b = at[g[counts], a[counts]], at[g[counts], b[counts]]
                # Both rows of a link carry the other's weight, one of them the link itself.
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate((node[a], node[b]))), pa.array(np.concatenate((node[b], node[b])), mask=np.arange(2 * len(a)) >= len(a)), pa.array(np.concatenate((n[b], n[a])))], names=["node", "other", "weight"])
                continue
            own = at[0]
            v, c, s, cell = _unit(x[own]), code[own], side[own], (t[own[0]], key.view(np.uint64)[own[0]])
            across = i[own[0]] != j[own[0]]  # a pair of blocks: only what lies between them

            def hits(lo, hi, v=v, c=c, s=s, cell=cell, across=across):
                near = v[lo:hi] @ v.T >= threshold
                if across:
                    near &= s[lo:hi, None] != s
                a, b = np.nonzero(near)
                near[a, b] = index.counts_here(c[lo + a], c[b], *cell)
                return near

            yield _linked(node[own], n[own], hits)

    return run


def _dealt(rows: DataFrame, keys: list[str], side: str, partitions: int) -> DataFrame:
    """rows with block numbers i and j, each row in all pairs of blocks that its own (of `blocks`) belongs to, sorted by keys, i, j."""
    placed = rows.withColumn("b", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = placed.withColumn("i", F.least("b", "o")).withColumn("j", F.greatest("b", "o")).withColumn(side, (F.col("b") > F.col("o")).cast("int"))
    return placed.repartition(partitions, *keys, "i", "j").sortWithinPartitions(*keys, "i", "j")


def _hot_links(d: DataFrame, coded: DataFrame, hot: list, leaders: np.ndarray, radius: float, threshold: float, block: int, partitions: int) -> DataFrame:
    """Links of members of hot balls: with each other by count alone, with what lies around by comparison."""
    numbers = np.array([r.ball for r in hot], np.int64)
    spark = d.sparkSession
    known = spark.createDataFrame([(r.ball, r.least, r.total) for r in hot], "ball long, least long, total long")  # LEADERS rows at most
    own = d.join(coded.select(F.col("node").alias("c"), "ball"), F.col("node") == F.col("c")).drop("c")
    inner = own.join(F.broadcast(known), "ball").select("node", F.when(F.col("node") != F.col("least"), F.col("least")).alias("other"), (F.col("total") - F.col("n")).cast("long").alias("weight"))
    reach = np.array([2 * radius + r.widest + 1e-7 for r in hot])
    around = staged(own.select("node", "n", "x", "ball").mapInArrow(_near_balls(numbers, leaders[numbers], reach), "hot long, outer int, node long, n long, x array<double>"))
    sizes = {(r.hot, r.outer): r["count"] for r in around.groupBy("hot", "outer").count().collect()}
    parts = [(int(k), o, max(1, -(-sizes.get((k, 1 - o), 0) // block)), max(1, -(-sizes[(k, o)] // block))) for k in numbers for o in (0, 1) if sizes.get((k, 0)) and sizes.get((k, 1))]
    if not parts:
        return inner
    plan = spark.createDataFrame(parts, "h long, o int, others int, blocks int")  # two rows a hot ball
    placed = around.join(F.broadcast(plan), (F.col("hot") == F.col("h")) & (F.col("outer") == F.col("o")))
    mine, theirs = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("others") - 1))
    placed = placed.withColumn("mine", mine).withColumn("theirs", theirs)
    placed = placed.withColumn("i", F.when(F.col("outer") == 0, F.col("mine")).otherwise(F.col("theirs"))).withColumn("j", F.when(F.col("outer") == 0, F.col("theirs")).otherwise(F.col("mine")))
    placed = placed.select("hot", "i", "j", "outer", "node", "n", "x").repartition(partitions, "hot", "i", "j").sortWithinPartitions("hot", "i", "j")
    return inner.unionByName(placed.mapInArrow(_across(threshold), LINKS))


def _links(d: DataFrame, rows: int, threshold: float, reach: float, block: int, most: int) -> DataFrame:
    """d(node, n, x), vectors of one length -> rows (node, other, weight)."""
    partitions = int(d.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sample = np.array([r.x for r in smallest(d.select("x"), hash_key("x", 0), SAMPLE_ROWS).collect()], float)
    index = index_for(rows, threshold, fit(sample, 64).codes(sample))
    model = fit(sample, 64 * max(index.words(), 4))
    leaders, radius = sample[:LEADERS] / np.linalg.norm(sample[:LEADERS], axis=1, keepdims=True), math.acos(threshold) / 2 - 1e-7
    names = [f"w{i}" for i in range(-(-model.axes.shape[1] // 64))]
    coded = staged(d.select("node", "x").mapInArrow(_coded(model, leaders, radius), "node long, " + ", ".join(f"{w} long" for w in names) + ", ball long, angle double"))
    weighed = coded.where("ball IS NOT NULL").join(d.select(F.col("node").alias("d"), "n"), F.col("node") == F.col("d"))
    hot = weighed.groupBy("ball").agg(F.min("node").alias("least"), F.sum("n").alias("total"), F.max("angle").alias("widest"), F.count("*").alias("members")).where(F.col("members") > block).collect()  # LEADERS rows at most
    cold = coded.where(~F.coalesce(F.col("ball").isin([r.ball for r in hot]), F.lit(False))) if hot else coded
    entries = []
    for t in range(index.tables):
        own = F.shiftrightunsigned(names[t // index.per], index.bits * (t % index.per)).bitwiseAND(F.lit((1 << index.bits) - 1).cast("long"))
        entries += [F.struct(F.lit(t).cast("long").alias("t"), own.bitwiseXOR(F.lit(flip).cast("long")).alias("key")) for flip in (0, *(1 << b for b in range(index.bits)))]
    entered = cold.select("node", *names, F.inline(F.array(*entries))).select("t", "key", "node", *names)
    entered = entered.repartition(partitions, "t", "key").sortWithinPartitions("t", "key")
    met = staged(entered.mapInArrow(_meet(index, int(reach * model.axes.shape[1]), most), "t long, key long, node long"))
    size = met.groupBy("t", "key").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    full = d.join(cold.select(F.col("node").alias("c"), *names), F.col("node") == F.col("c")).drop("c").withColumnRenamed("node", "k")
    dealt = _dealt(met.join(size, ["t", "key"]).join(full, F.col("node") == F.col("k")), ["t", "key"], "side", partitions)
    links = dealt.select("t", "key", "i", "j", "side", "node", "n", "x", *names).mapInArrow(_rerank(index, threshold), LINKS)
    return links.unionByName(_hot_links(d, coded, hot, leaders, radius, threshold, block, partitions)) if hot else links


def near_vectors(
    vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = 0.9, reach: float = 0.215, block: int = 512, most: int = 4096,
) -> DataFrame:
    """One row a vector: vec_id, n_links, component_id, kept. reach is a share of the code's bits."""
    rows, distinct = nodes(vectors, id_col, vec_col)
    lengths = {r["size"]: r["count"] for r in distinct.groupBy(F.size("x").alias("size")).count().collect()}  # a row a length
    found = [_links(distinct.where(F.size("x") == n).select("node", "n", "x"), count, threshold, reach, block, most) for n, count in sorted(lengths.items()) if count > 1]
    if found:
        compared = staged(reduce(DataFrame.unionByName, found))
    else:
        compared = vectors.sparkSession.createDataFrame([], LINKS)
    links = compared.groupBy("node").agg(F.sum("weight").alias("weight")).withColumnRenamed("node", "l")
    roots = components(compared.where("other IS NOT NULL").select(F.col("node").alias("a"), F.col("other").alias("b"))).withColumnRenamed("node", "c")
    whole = distinct.select("node", "low", "n").join(roots, F.col("node") == F.col("c"), "left").join(links, F.col("node") == F.col("l"), "left")
    whole = whole.select("node", "low", F.coalesce("root", "node").alias("root"), (F.col("n") - 1 + F.coalesce("weight", F.lit(0))).alias("n_links"))
    lowest = whole.groupBy("root").agg(F.min("low").alias("component_id"))
    by_node = whole.join(lowest, "root").select(F.col("node").alias("k"), "n_links", "component_id")
    out = rows.join(by_node, F.col("node") == F.col("k"), "left")
    component = F.when(F.col("node").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(False)).alias("kept"))


def op8(vectors: DataFrame) -> DataFrame:
    """vec_id, n_links, component_id, kept of all rows of embeddings."""
    return near_vectors(vectors)
