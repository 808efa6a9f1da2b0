"""Quality selection by importance resampling.

Two generative models over hashed word n-grams (one and two words) give every document a log importance
weight: the sum over its n-grams of the log ratio of their chances in target and raw text. The target model counts
labelled good documents, the raw model all documents; of a bucket that the target model has n times and the raw
one would lead to expect e times, the ratio is (n + PRIOR) / (e + PRIOR), so buckets too rare to tell say little. Selection is sampling without replacement in proportion to the
weights by Gumbel top-k: the k largest log weights, each with standard Gumbel noise drawn from a
hash of the id. k, which Gumbel top-k needs, is the number of documents whose weight reaches the level that
best separates labelled good from labelled bad ones (all are kept where labels lack one kind), so the
share kept follows the corpus rather than a constant.

The k-th largest key is found exactly by counting leading bits of the keys, 12 at a time, so no task or
driver ever holds the keys.

Defined results: null or empty text has weight 0; rows whose key equals the k-th largest are all
kept, so repeated rows stay or go together; labels without a document and
null labels are ignored; no labelled good document keeps everything; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aspectdrift.llm.common import hash_key, mix, smallest, staged, text_blocks, token_hashes

BUCKETS, PRIOR = 1 << 17, 16.0


def ngrams(data: np.ndarray, starts: np.ndarray, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """(document index, bucket) of every one- and two-word n-gram of a block."""
    at, h = token_hashes(data)
    doc = np.searchsorted(starts, at, side="right") - 1
    same = doc[1:] == doc[:-1]
    pair = mix(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:])[same]
    return np.concatenate((doc, doc[:-1][same])), np.concatenate((h, pair)) % np.uint64(buckets)


def _tally(good: np.ndarray, buckets: int):
    def run(batches):
        total = np.zeros((2, buckets), np.int64)
        for batch in batches:
            in_target = _among(batch.column(0), good)
            for first, _, data, starts in text_blocks(batch.column(1)):
                doc, b = ngrams(data, starts, buckets)
                b = b.astype(np.int64)
                total[0] += np.bincount(b, minlength=buckets)
                total[1] += np.bincount(b[in_target[first + doc]], minlength=buckets)
        seen = np.flatnonzero(total[0])
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[0][seen]), pa.array(total[1][seen])], names=["bucket", "raw", "target"])

    return run


def _among(ids: pa.Array, sorted_ids: np.ndarray) -> np.ndarray:
    known = ids.is_valid().to_numpy(zero_copy_only=False)
    x = ids.fill_null(0).to_numpy(zero_copy_only=False)
    return known & np.isin(x, sorted_ids)


def models(rows: DataFrame, good: np.ndarray, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """rows(id, text) -> n-gram counts of all documents and of those whose id is in good."""
    counts = rows.select("id", "text").mapInArrow(_tally(good, buckets), "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    raw, target = np.zeros(buckets), np.zeros(buckets)
    for r in counts.collect():  # `buckets` rows
        raw[r.bucket], target[r.bucket] = r.raw, r.target
    return raw, target


def _weigh(raw: np.ndarray, target: np.ndarray, good: np.ndarray):
    """Columns id, text, a hash of the id and row -> id, row, log_weight, key_bits.

    A document of the target model is weighed by the model without it, so that it is no better off than others.
    """
    size = len(raw)
    share, total = raw / max(raw.sum(), 1), target.sum()

    def run(batches):
        for batch in batches:
            w, in_target = np.zeros(batch.num_rows), _among(batch.column(0), good)
            for first, last, data, starts in text_blocks(batch.column(1)):
                doc, b = ngrams(data, starts, size)
                n = np.bincount(doc, minlength=last - first)
                cell, count = np.unique(doc * size + b.astype(np.int64), return_counts=True)
                d, b = cell // size, cell % size
                own = in_target[first:last][d]
                ratio = (target[b] - own * count + PRIOR) / ((total - own * n[d]) * share[b] + PRIOR)
                w[first:last] = np.bincount(d, count * np.log(ratio), minlength=last - first)
            h = batch.column(2).to_numpy(zero_copy_only=False).view(np.uint64)
            key = w - np.log(-np.log(((h >> np.uint64(11)).astype(float) + 0.5) / float(1 << 53)))
            bits = (key + 0.0).view(np.int64)
            bits = bits ^ ((bits >> 63) & np.int64((1 << 63) - 1))  # now in the order of the keys
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(3), pa.array(w), pa.array(bits)], names=["id", "row", "log_weight", "key_bits"])

    return run


def level(labelled: DataFrame, good_matters: float = 20.0, steps: int = 4096) -> float | None:
    """labelled(log_weight, good) -> the weight that best separates good from bad; None without both kinds.

    Losing a share of the good counts good_matters times as much as keeping that share of the bad.
    """
    low, high, kinds = labelled.agg(F.min("log_weight"), F.max("log_weight"), F.count_distinct("good")).first()
    if kinds < 2 or low == high:
        return None
    width = (high - low) / steps
    at = F.least(F.floor((F.col("log_weight") - low) / width), F.lit(steps - 1)).cast("int")
    good, bad = np.zeros(steps), np.zeros(steps)
    for r in labelled.groupBy(at.alias("at")).agg(F.count_if("good").alias("g"), F.count_if(~F.col("good")).alias("b")).collect():  # `steps` rows at most
        good[r["at"]], bad[r["at"]] = r.g, r.b
    lost, gone = np.cumsum(good) - good, np.cumsum(bad) - bad
    score = gone / bad.sum() - good_matters * lost / good.sum()
    best = np.flatnonzero(score >= score.max() - 1e-12)
    return low + width * int(best[len(best) // 2])


def kth_key(keys: DataFrame, k: int) -> int:
    """The k-th largest key_bits, by counting 12 leading bits at a time."""
    turned = F.col("key_bits").bitwiseXOR(F.lit(-(1 << 63)).cast("long"))
    prefix, known = 0, 0
    while known < 64:
        step = min(12, 64 - known)
        digit = F.shiftrightunsigned(turned, 64 - known - step).bitwiseAND(F.lit((1 << step) - 1).cast("long"))
        here = keys.where(F.shiftrightunsigned(turned, 64 - known) == F.lit(prefix).cast("long")) if known else keys
        for d, n in sorted(((r["d"], r["count"]) for r in here.groupBy(digit.alias("d")).count().collect()), reverse=True):  # 4096 rows at most
            if k <= n:
                break
            k -= n
        prefix, known = prefix << step | d, known + step
    return (prefix ^ (1 << 63)) - (1 << 64) if (prefix ^ (1 << 63)) >> 63 else prefix ^ (1 << 63)


def selected(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", good_col: str = "quality",
    seed: int = 11, buckets: int = BUCKETS, target_docs: int = 20_000, row_col: str | None = None,
) -> DataFrame:
    """One row a document: id, row (row_col, which tells rows of one id apart), log_weight, key_bits (the Gumbel key as
    an ordered long), selected.

    The target model counts the target_docs good documents with the smallest id hash, so only a bounded
    list of ids is sent out; the raw model counts every document and the level is set on every labelled one.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(good_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("l_id")).agg((F.min(good_col) > 0).alias("good"))
    good = np.sort(np.array([r.l_id for r in smallest(known.where("good"), hash_key("l_id", seed + 1), target_docs, "l_id").collect()], np.int64))
    row = F.col(row_col).cast("long") if row_col else F.lit(None).cast("long")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), row.alias("row"))
    raw, target = models(rows, good, buckets)
    hashed = rows.select("id", "text", F.xxhash64("id", F.lit(seed)).alias("h"), "row")
    scored = staged(hashed.mapInArrow(_weigh(raw, target, good), "id long, row long, log_weight double, key_bits long"))
    labelled = scored.join(known, scored["id"] == known["l_id"]).select("log_weight", "good")
    at = level(labelled)
    if at is None:
        return scored.withColumn("selected", F.lit(True))
    k = scored.where(F.col("log_weight") >= at).count()
    return scored.withColumn("selected", F.col("key_bits") >= F.lit(kth_key(scored, k)).cast("long") if k else F.lit(False))


def op5(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, log_weight, selected of all documents."""
    return selected(docs, labels).select(F.col("id").alias("doc_id"), "log_weight", "selected")
