"""Plumbing shared by the training-data operators: scratch tables, components, byte-level tokens, cells of sorted rows."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Documents handed to numpy at once hold about so many bytes of text.
BLOCK_BYTES = 4 << 20


def scratch_dir(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, gone when the JVM ends.

    Where that is unset, a folder of this machine serves a local master; on a cluster, whose executors
    wouldn't share it, it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file:///tmp/checkpoints/aspectdrift"
    path = f"{base.rstrip('/')}/llm-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(where)
    fs.deleteOnExit(where)
    return path


def staged(df: DataFrame) -> DataFrame:
    """Write df once to the shared scratch folder and read it back; cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch_dir(spark) + "/table"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


KEYS = 1 << 40


def hash_key(col: str | Column, seed: int | str) -> Column:
    """A key from 0 to KEYS - 1."""
    return F.pmod(F.xxhash64(F.col(col) if isinstance(col, str) else col, F.lit(seed)), F.lit(KEYS))


def smallest(df: DataFrame, key: Column, most: int, *then: str) -> DataFrame:
    """The rows with the `most` smallest hash keys; a bound from the row count keeps all but about twice as many at home."""
    rows = df.count()
    bound = KEYS if rows <= 2 * most else 2 * most * KEYS // rows + 1
    return df.withColumn("__key", key).where(F.col("__key") < bound).orderBy("__key", *then).limit(most).drop("__key")


def text_or_empty(text: str | Column) -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Connected components of edges(a, b), any order, repeats allowed: rows (node, root), root the smallest node.

    Alternating large-star and small-star steps; every round is written to the shared folder. Stars
    are built with a partially aggregated minimum and an equi-join, so a node with very many
    neighbours is a skewed join side that AQE can split, never a collected list. Nodes without an
    edge are absent; an empty input gives no rows.
    """
    pairs = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    pairs = staged(pairs)
    before = None
    for _ in range(most_rounds):
        mark = pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark[0] == 0 or mark == before:
            break
        before = mark
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        small = small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.withColumnRenamed("m", "b"))
        pairs = staged(small.where("a <> b").distinct())
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    roots = pairs.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)


class Labels:
    """Vectorised union of linked members of one block: label[i] is the smallest member index joined with i."""

    def __init__(self, n: int) -> None:
        self.label = np.arange(n)

    def join_rows(self, first: int, linked: np.ndarray) -> None:
        """linked[i, j]: member first + i is linked with member j."""
        for i in np.flatnonzero(linked.any(axis=1)):
            found = self.label[linked[i]]
            own = self.label[first + i]
            low = min(int(found.min()), int(own))
            if own != low or (found != low).any():
                self.label[np.isin(self.label, np.append(found, own))] = low


# ---------------------------------------------------------------- bytes

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_WORD = np.zeros(256, bool)
_WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), 0x5F, *range(0x80, 0x100)]] = True
#: 0 white space, 1 letters, digits and all non-ASCII bytes, 2 other ASCII signs.
BYTE_CLASS = np.where(_SPACE, 0, np.where(_WORD, 1, 2)).astype(np.uint8)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


def _powers(n: int, base: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[0] = 1
    if n > 1:
        out[1:] = np.uint64(base)
        np.multiply.accumulate(out, out=out)
    return out


_POWERS: dict[str, np.ndarray] = {"to": np.empty(0, np.uint64), "back": np.empty(0, np.uint64)}


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads 64-bit values (wraps on purpose)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def token_hashes(data: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Start of each token in UTF-8 bytes `data` and its 64-bit hash; tokens are maximal runs of one byte class.

    A polynomial over all bytes, taken modulo 2**64, gives every token's hash from two prefix sums.
    """
    if lower:
        data = np.where((data >= 0x41) & (data <= 0x5A), data | 0x20, data)
    kind = BYTE_CLASS[data]
    if not len(data):
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    edge = np.flatnonzero(np.diff(kind)) + 1
    start = np.concatenate(([0], edge))
    stop = np.concatenate((edge, [len(data)]))
    keep = kind[start] != 0
    start, stop = start[keep], stop[keep]
    n = len(data) + 1
    if len(_POWERS["to"]) < n:
        _POWERS["to"] = _powers(n, int(_BASE))
        _POWERS["back"] = _powers(n, pow(int(_BASE), -1, 1 << 64))
    total = np.zeros(n, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _POWERS["to"][: n - 1], out=total[1:])
    return start, mix((total[stop] - total[start]) * _POWERS["back"][start] + (stop - start).astype(np.uint64))


def text_blocks(texts, most: int = BLOCK_BYTES):
    """Yield (first, last, data, starts): documents first..last-1 of an Arrow string array as one byte array.

    Documents are joined by one newline; starts has each document's first byte and the end. A document
    is never cut: one longer than `most` is a block of its own. Nulls are empty.
    """
    parts, first, held = [], 0, 0
    items = texts.to_pylist()
    for i, text in enumerate(items):
        b = (text or "").encode("utf-8", "surrogatepass")
        if parts and held + len(b) > most:
            yield first, i, *_joined(parts)
            parts, first, held = [], i, 0
        parts.append(b)
        held += len(b) + 1
    if parts:
        yield first, len(items), *_joined(parts)


def _joined(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    starts = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(b) + 1 for b in parts], out=starts[1:])
    return np.frombuffer(b"\n".join(parts) + b"\n", np.uint8), starts


# ---------------------------------------------------------------- cells of a multi-index


def cells_of(batches, keys: int, most: int, small: int = 12):
    """Cells of a stream of record batches sorted by their first `keys` columns, as (columns, members).

    columns are numpy arrays; members, an index array (cells, m), holds cells of one size m, small ones many
    at a time. A cell of over `most` rows comes in parts as it streams by, each as (columns, None).
    """
    held: list[list[np.ndarray]] = []
    current, count = None, 0

    def joined() -> list[np.ndarray]:
        return [np.concatenate(c) for c in zip(*held, strict=True)]

    for batch in batches:
        cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(batch.num_columns)]
        n = batch.num_rows
        if not n:
            continue
        change = np.zeros(n - 1, bool)
        for k in cols[:keys]:
            change |= k[1:] != k[:-1]
        cut = np.flatnonzero(change) + 1
        lo, hi = np.concatenate(([0], cut)), np.concatenate((cut, [n]))
        size = hi - lo
        inner = np.ones(len(lo), bool)
        inner[[0, -1]] = False  # may go on in other batches
        for m in np.unique(size[inner & (size > 1) & (size <= small)]):
            at = lo[inner & (size == m)][:, None] + np.arange(m)
            for part in np.array_split(at, max(1, at.size * m >> 18)):
                yield cols, part
        for j in np.flatnonzero(~inner | (size > small)):
            key = tuple(k[lo[j]] for k in cols[:keys])
            if key != current:
                if 1 < count <= most:
                    yield joined(), np.arange(count)[None]
                held, current, count = [], key, 0
            held.append([c[lo[j] : hi[j]] for c in cols])
            count += int(size[j])
            if count > most:
                yield joined(), None
                held = []
    if 1 < count <= most:
        yield joined(), np.arange(count)[None]


def forest(n: int, near) -> tuple[np.ndarray, np.ndarray]:
    """Members of a cell and a member that each is linked with, so that they connect what links connect.

    near(a, b) gives the links of members a to b with all members as booleans.
    """
    labels, block = Labels(n), max(16, (1 << 20) // n)
    for at in range(0, n, block):
        hit = near(at, min(at + block, n))
        hit[np.arange(len(hit)), at + np.arange(len(hit))] = False
        labels.join_rows(at, hit)
    own = np.flatnonzero(labels.label != np.arange(n))
    return own, labels.label[own]
