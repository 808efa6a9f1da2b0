"""SimHash near-duplicates through a segment-popcount embedding.

A 64-bit fingerprint is mapped to the bit counts of its 32 two-bit segments. The Manhattan distance of two
such vectors never exceeds the Hamming distance, so fingerprints at 3 or fewer bits lie within distance 3.
The 32 coordinates are cut into six groups; of two vectors within distance 3 at least three groups are
equal, so a grid over each choice of three groups (20 of them) has a cell that holds both. Every distinct
fingerprint is dealt to its 20 cells; inside a cell, pairs pass the Manhattan bound over all coordinates
and then the exact test. A cell emits a spanning forest of its links, never its pairs.

A cell of more than `most` fingerprints is split by the grid's other coordinates: cut into four parts, at
least one of them is equal too, so its members are dealt to a finer cell for each part. Cells that are
crowded even then, fingerprints alike in most of the 32 counts, take a linear way: two fingerprints within 3 bits
share a value that is at most 2 flips from one and at most 1 from the other, so these are joined on such values.

Defined results: texts without words, nulls among them, have fingerprint zero and link like any others;
equal fingerprints are one node, so copies are never compared; a group whose ids are all null has a null
component; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aspectdrift.llm.common import cells_of, components, forest, staged

SHINGLE = 3
REACH = 3
_PAIR = 0x5555555555555555
#: Segments of each group; a segment is two neighbouring bits.
GROUPS = (range(0, 6), range(6, 12), range(12, 17), range(17, 22), range(22, 27), range(27, 32))


def fingerprint(text: bytes, size: int = SHINGLE) -> int:
    """Bits set in over half of the XXH64 values (seed 42) of the shingles of a UTF-8 text, A-Z lower-cased."""
    import xxhash

    words = text.lower().split()  # of bytes: ASCII letters and the six ASCII blanks only
    if not words:
        return 0
    joined, n = b" ".join(words), len(words)
    digest = xxhash.xxh64_intdigest
    if n <= size:
        return digest(joined, 42)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate(([0], ends[: n - size] + 1)).tolist()
    h = np.array([digest(joined[a:b], 42) for a, b in zip(starts, ends[size - 1 :].tolist(), strict=True)], "<u8")
    bits = np.zeros(64, np.int64)
    for at in range(0, len(h), 65536):
        part = h[at : at + 65536]
        bits += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(sum(1 << k for k in np.flatnonzero(2 * bits > len(h)).tolist()))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, fp): fp is the fingerprint as a signed long."""
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))

    def run(batches):
        for batch in batches:
            fp = np.array([fingerprint(t or b"") for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], names=["id", "fp"])

    return source.mapInArrow(run, "id long, fp long")


def embedded(fp: np.ndarray) -> np.ndarray:
    """The 32 bit counts, packed two bits each."""
    return fp - ((fp >> np.uint64(1)) & np.uint64(_PAIR))


def manhattan(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distance of packed vectors: fields 1 and 3 of the exclusive or differ by one, 2 (that is 0 against 2) by two."""
    x = a ^ b
    odd = x & np.uint64(_PAIR)
    two = (x >> np.uint64(1)) & ~x & np.uint64(_PAIR)
    return np.bitwise_count(odd) + 2 * np.bitwise_count(two)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _mask(segments) -> Column:
    return F.lit(_signed(sum(3 << (2 * s) for s in segments))).cast("long")


def _packed() -> Column:
    """The embedding of column fp, as embedded() gives it."""
    low, high = F.col("fp").bitwiseAND(F.lit(_PAIR)), F.shiftrightunsigned("fp", 1).bitwiseAND(F.lit(_PAIR))
    return low.bitwiseXOR(high).bitwiseOR(F.shiftleft(low.bitwiseAND(high), 1))


CHOICES = [[s for g in chosen for s in GROUPS[g]] for chosen in combinations(range(len(GROUPS)), len(GROUPS) - REACH)]


def cells(fps: DataFrame) -> DataFrame:
    """Rows (cell, key, fp): 20 cells of every fingerprint, all with column arithmetic."""
    at = [F.struct(F.lit(k).cast("long").alias("cell"), F.col("e").bitwiseAND(_mask(own)).alias("key")) for k, own in enumerate(CHOICES)]
    return fps.select("fp", _packed().alias("e")).select("fp", F.inline(F.array(*at))).select("cell", "key", "fp")


def finer_cells(crowded: DataFrame) -> DataFrame:
    """crowded(cell, fp) -> rows (cell, key, fp): four finer cells, each with one more part of the coordinates."""
    by = F.lit(None)
    for k, own in enumerate(CHOICES):
        rest = [s for s in range(32) if s not in own]
        parts = [rest[len(rest) * j // (REACH + 1) : len(rest) * (j + 1) // (REACH + 1)] for j in range(REACH + 1)]
        finer = [F.struct(F.lit((REACH + 1) * k + j).cast("long").alias("cell"), F.col("e").bitwiseAND(_mask(own + part)).alias("key")) for j, part in enumerate(parts)]
        by = F.when(F.col("cell") == k, F.array(*finer)).otherwise(by)
    return crowded.select("cell", "fp", _packed().alias("e")).select("fp", by.alias("at")).select("fp", F.inline("at")).select("cell", "key", "fp")


def near(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Within REACH bits: the Manhattan bound first, the exact count where it holds."""
    x, y = np.broadcast_arrays(x[..., 0], y[..., 0])
    hit = manhattan(embedded(x), embedded(y)) <= REACH
    hit[hit] = np.bitwise_count(x[hit] ^ y[hit]) <= REACH
    return hit


def _flips(reach: int) -> list[int]:
    return [_signed(sum(1 << i for i in at)) for n in range(reach + 1) for at in combinations(range(64), n)]


def near_by_flips(fps: DataFrame) -> DataFrame:
    """Links among fingerprints of crowded cells, in linear work: a forest over shared values.

    Every fingerprint is written at all values up to two flips away. A value that some fingerprint is at
    most one flip from links that one, its hub, with everything at the value: distance 3 or less.
    """
    flips = F.explode(F.array(*[F.struct(F.lit(x).cast("long").alias("x"), F.lit(bin(x & (2**64 - 1)).count("1")).alias("n")) for x in _flips(2)]))
    at = fps.select("fp", flips.alias("s")).select("fp", F.col("fp").bitwiseXOR(F.col("s.x")).alias("value"), F.col("s.n").alias("n"))
    hubs = at.where("n <= 1").groupBy("value").agg(F.min("fp").alias("hub"))
    return at.join(hubs, "value").where("fp <> hub").select(F.col("fp").alias("a"), F.col("hub").alias("b")).distinct()


def _edges(most: int):
    """For mapInArrow over sorted rows (cell, key, fp): (a, b, cell). Members of crowded cells come with a null b."""

    def run(batches):
        for (cell, _, fp), at in cells_of(batches, 2, most):
            x = fp.view(np.uint64)[:, None]
            if at is None:
                a, b, c = fp, pa.nulls(len(fp), pa.int64()), cell
            elif len(at) > 1 or at.shape[1] <= 12:
                g, i, j = np.nonzero(near(x[at][:, :, None], x[at][:, None]) & np.tri(at.shape[1], k=-1, dtype=bool))
                a, b, c = fp[at[g, i]], pa.array(fp[at[g, j]]), cell[at[g, i]]
            else:
                i, j = forest(len(x), lambda lo, hi, x=x: near(x[lo:hi, None], x[None]))
                a, b, c = fp[i], pa.array(fp[j]), cell[i]
            yield pa.RecordBatch.from_arrays([pa.array(a), b, pa.array(c)], names=["a", "b", "cell"])

    return run


def links(fps: DataFrame, most: int = 32768, partitions: int | None = None) -> DataFrame:
    """fps(fp), distinct -> edges (a, b) that connect exactly what links of 3 or fewer bits connect."""
    n = partitions or int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def found(dealt: DataFrame) -> DataFrame:
        dealt = dealt.repartition(n, "cell", "key").sortWithinPartitions("cell", "key")
        return staged(dealt.mapInArrow(_edges(most), "a long, b long, cell long"))

    met = found(cells(fps))
    edges, hot = met.where("b IS NOT NULL").select("a", "b"), met.where("b IS NULL").select("cell", F.col("a").alias("fp")).distinct()
    if hot.isEmpty():
        return edges
    met = found(finer_cells(hot))
    edges, hot = edges.unionByName(met.where("b IS NOT NULL").select("a", "b")), met.where("b IS NULL").select(F.col("a").alias("fp")).distinct()
    return edges if hot.isEmpty() else edges.unionByName(near_by_flips(hot))


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: id, fp, component_id (the smallest id reachable over links)."""
    prints = staged(fingerprints(docs, id_col, text_col))
    nodes = staged(prints.groupBy("fp").agg(F.min("id").alias("low")))
    roots = components(links(nodes.select("fp")))
    joined = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    lowest = joined.groupBy("root").agg(F.min("low").alias("component_id"))
    by_print = joined.select("fp", "root").join(lowest, "root").select(F.col("fp").alias("f"), "component_id")
    return prints.join(by_print, F.col("fp") == F.col("f")).select("id", "fp", "component_id")


def op7(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint, component_id of all documents."""
    return near_groups(docs).select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
