"""Best-fit packing by patterns: non-negative least squares over few-document length patterns.

Only the histogram of piece lengths, at most `width` numbers, reaches the driver. Patterns of one to
three lengths that fill a sequence exactly are fitted to it by non-negative least squares, rounded
down, and what they leave is packed best-fit decreasing, still by length and count. Every length then
has a list of rank ranges, each a slot of a pattern; a document's rank among pieces of its length finds
its slot. The plan has a bounded number of rows whatever the number of documents.

Defined results: null or empty text is the end token alone; repeated rows and null ids are packed row
by row; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import json
import re
import zlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from aspectdrift.llm.common import staged

# ---------------------------------------------------------------- tokens

_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The fast library's matcher recurses over a run of blanks; texts with such a run go the plain way, which doesn't.
_BLANK_RUN = re.compile(r"\s{4096}")


def _byte_of() -> dict[str, int]:
    """Byte-level BPE writes printable bytes as themselves and the others as code points from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in plain}
    for b in sorted(set(range(256)) - set(plain)):
        out[chr(256 + len(out) - len(plain))] = b
    return out


@cache
def encoder(path: str):
    """encode(list of texts) -> list of id lists, as `tokenizers` gives them for the file at path.

    The file's own vocabulary is also loaded as byte ranks into tiktoken, about five times as fast,
    and used where a probe agrees; texts with an added token's string or a very long run of blanks always
    go the plain way.
    """
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(path)
    slow = lambda texts: [e.ids for e in plain.encode_batch(texts, add_special_tokens=False)]
    try:
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        added = [t["content"] for t in spec.get("added_tokens", [])]
        back = _byte_of()
        ranks = {bytes(back[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in added}
        fast = tiktoken.Encoding("from-file", pat_str=_PIECES, mergeable_ranks=ranks, special_tokens={})
        probe = ["It's 12,345 naïve cafés —\n\n  ok\t\t x", "ÄÖÜ ß ñandú!!! %%%&&& \r\n 　z", "a" * 50 + " \U0001f600 don't we'll I'd 9.99", ""]
        if [fast.encode_ordinary(t) for t in probe] != slow(probe):
            return slow
    except (ImportError, KeyError):
        return slow

    def encode(texts: list[str]) -> list[list[int]]:
        return [slow([t])[0] if any(a in t for a in added) or _BLANK_RUN.search(t) else fast.encode_ordinary(t) for t in texts]

    return encode


def pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", width: int = 1024, end: int = 2) -> DataFrame:
    """Rows (id, piece, start, length, ids_crc32): the documents' ids with `end`, cut only where longer than width."""
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        encode = encoder(tokenizer)
        for batch in batches:
            cols: list[list] = [[], [], [], [], []]
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = encode([text or ""])[0]
                ids.append(end)
                raw, first = np.array(ids, "<u4").tobytes(), len(ids) % width or width
                stops = range(first, len(ids) + 1, width)
                for k, stop in enumerate(stops):
                    start = stop - width if k else 0
                    for to, x in zip(cols, (i, k, start, stop - start, zlib.crc32(raw[4 * start : 4 * stop])), strict=True):
                        to.append(x)
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["id", "piece", "start", "length", "ids_crc32"])

    return source.mapInArrow(run, "id long, piece int, start long, length long, ids_crc32 long")


# ---------------------------------------------------------------- plan


def patterns(width: int, present: np.ndarray) -> np.ndarray:
    """All ascending triples of lengths, 0 for none, that sum to width and whose lengths are all present."""
    have = np.flatnonzero(present)
    have = have[(have > 0) & (have <= width)]
    out = [np.array([[0, 0, width]])] if len(have) and have[-1] == width else []
    low = np.concatenate(([0], have))
    for a in low:
        b = low[(low >= a) & (low > 0)]
        c = width - a - b
        ok = c >= b
        b, c = b[ok], c[ok]
        ok = present[c] if len(c) else np.empty(0, bool)
        out.append(np.stack([np.full(ok.sum(), a), b[ok], c[ok]], axis=1))
    return np.concatenate(out).astype(np.int64) if out else np.empty((0, 3), np.int64)


def fit(counts: np.ndarray, pats: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Non-negative x that makes the patterns' lengths come near the counts in least squares.

    Multiplicative updates x *= A'h / A'Ax keep x non-negative and never raise the residual. Each bin
    is scaled by its count, so rare lengths count as much as common ones.
    """
    if not len(pats):
        return np.empty(0)
    scale = np.where(counts > 0, 1.0 / np.maximum(counts, 1), 0.0)
    scale[0] = 0.0
    want = scale * scale * counts
    gain = want[pats].sum(axis=1)
    x = np.full(len(pats), 1.0)
    flat, n = pats.ravel(), len(counts)
    x *= counts[1:].sum() / (3.0 * len(pats))
    for _ in range(rounds):
        made = np.bincount(flat, np.repeat(x, 3), minlength=n) * scale * scale
        x *= gain / np.maximum(made[pats].sum(axis=1), 1e-300)
    return x


def plan(histogram: dict[int, int], width: int) -> list[tuple[list[tuple[int, int]], int]]:
    """Kinds of sequences and how many of each: [([(length, offset), ...], repeats)], all pieces placed once."""
    left = np.zeros(width + 1, np.int64)
    for length, n in histogram.items():
        left[length] = n
    out: list[tuple[list[int], int]] = []
    pats = patterns(width, left > 0)
    x = np.floor(fit(left.astype(float), pats) + 1e-6).astype(np.int64) if len(pats) else np.empty(0, np.int64)

    def take(pattern: list[int], most: int) -> None:
        need = {k: pattern.count(k) for k in pattern}
        n = min([most, *(int(left[k]) // m for k, m in need.items())])
        if n > 0:
            for k, m in need.items():
                left[k] -= n * m
            out.append((sorted(pattern, reverse=True), n))

    for j in np.argsort(-x, kind="stable"):
        if x[j] <= 0:
            break
        take([int(k) for k in pats[j] if k], int(x[j]))
    # Residuals: best fit, longest first; bins of one kind are handled together.
    room: dict[int, list[list]] = {}
    for length in range(width, 0, -1):
        n = int(left[length])
        while n:
            free = min((r for r in room if r >= length), default=None)
            if free is None:
                per = min(width // length, n)
                bins = n // per
                room.setdefault(width - per * length, []).append([[length] * per, bins])
            else:
                kinds = room[free]
                items, have = kinds[-1]
                per = min(free // length, n)
                bins = min(have, n // per)
                kinds[-1][1] -= bins
                if not kinds[-1][1]:
                    kinds.pop()
                if not kinds:
                    del room[free]
                room.setdefault(free - per * length, []).append([items + [length] * per, bins])
            n -= bins * per
    out += [(items, n) for kinds in room.values() for items, n in kinds]
    return [([(k, o) for k, o in zip(items, np.cumsum([0, *items])[:-1].tolist(), strict=True)], n) for items, n in out]


def slots(kinds: list[tuple[list[tuple[int, int]], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, last rank + 1, first sequence, offset) of every slot; ranks count from 0 per length."""
    used: dict[int, int] = {}
    out, sequence = [], 0
    for items, n in kinds:
        for length, offset in items:
            at = used.get(length, 0)
            out.append((length, at, at + n, sequence, offset))
            used[length] = at + n
        sequence += n
    return out


def pack(cut: DataFrame, width: int = 1024, buckets: int | None = None) -> DataFrame:
    """cut, rows with (id, piece, length), with sequence_id and offset. Pieces of one length are alike to the plan."""
    spark = cut.sparkSession
    histogram = {r[0]: r[1] for r in cut.groupBy("length").count().collect()}  # at most `width` rows
    table = slots(plan(histogram, width))
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = cut.withColumn("bucket", F.pmod(F.xxhash64("id", "piece", "start"), F.lit(n)).cast("int"))
    inside = F.row_number().over(Window.partitionBy("bucket", "length").orderBy("id", "piece", "start")) - 1
    sums = placed.groupBy("bucket", "length").agg(F.count("*").alias("n"))
    before = sums.select("bucket", "length", F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    ranked = placed.withColumn("inside", inside).join(before, ["bucket", "length"]).withColumn("rank", F.col("inside") + F.col("before"))
    by: dict[int, list[tuple[int, int, int]]] = {}
    for length, lo, _, sequence, offset in table:
        by.setdefault(length, []).append((lo, sequence, offset))

    def place(batches):
        starts = {k: (np.array([r[0] for r in v]), np.array([r[1] for r in v]), np.array([r[2] for r in v])) for k, v in by.items()}
        for batch in batches:
            length, rank = batch.column("length").to_numpy(zero_copy_only=False), batch.column("rank").to_numpy(zero_copy_only=False)
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for k in np.unique(length):
                own = np.flatnonzero(length == k)
                lo, first, off = starts[int(k)]
                at = np.searchsorted(lo, rank[own], side="right") - 1
                sequence[own], offset[own] = first[at] + rank[own] - lo[at], off[at]
            keep = [c for c in batch.schema.names if c != "rank"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(sequence), pa.array(offset)], names=[*keep, "sequence_id", "offset"])

    return ranked.select(*cut.columns, "rank").mapInArrow(place, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema.fields) + ", sequence_id long, offset long")


def packed(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", width: int = 1024) -> DataFrame:
    return pack(staged(pieces(docs, tokenizer, id_col, text_col, width)), width)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op4(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of all documents."""
    return packed(docs, tokenizer or default_tokenizer()).withColumnRenamed("id", "doc_id")
