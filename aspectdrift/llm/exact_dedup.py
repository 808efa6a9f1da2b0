"""Exact deduplication by content sort.

Normalised texts are range-partitioned by sampled splitters and sorted externally in every partition, so
equal texts are neighbours and a large group of copies simply spans several partitions. A splitter is
the first HEAD characters, a hash of the whole text and the id: the sample that the driver sees stays small
however long the texts are. Neighbours are compared in full. Only runs that share the hash of a
partition's first or last row can go on in another one; those, two a partition, are joined by their whole text.

Defined results: null text counts as empty; a null id sorts first and never becomes keep_id while the
group has another; repeated rows of the smallest id: the first one is kept; an empty table gives no
rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aspectdrift.llm.common import staged, text_or_empty

#: White space that normalisation folds.
BLANKS = r"[\x20\x09-\x0D]+"
HEAD = 32


def normalised(text: str | Column) -> Column:
    return F.regexp_replace(text_or_empty(text), BLANKS, " ")


def _runs(batches):
    """Rows (id, run, run_min, run_n, lead, edge, sha, edge_text) of a sorted partition, in order.

    A run is held back as ids only until it ends. lead marks its first row with the smallest id (its
    first row if all ids are null); edge the runs that may go on in another partition, whose lead
    carries the text.
    """
    part = TaskContext.get().partitionId()
    names = ["id", "run", "run_min", "run_n", "lead", "edge", "sha", "edge_text"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.string(), pa.string()]
    held: list[list] = [[] for _ in names]
    text, ids, number, mark, first, pending = None, [], 0, None, None, []

    def close() -> None:
        pending.append((text, ids, number))

    def settle(last: bool) -> None:
        """Put out the runs of one hash, which is mark."""
        for run in pending:
            put(*run, last or mark == first)
        pending.clear()

    def put(text: str, ids: list, number: int, edge: bool) -> None:
        n = len(ids)
        lead = next((k for k, x in enumerate(ids) if x is not None), 0)
        sha = hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()
        marks, texts = [False] * n, [None] * n
        marks[lead], texts[lead] = True, text if edge else None
        for to, more in zip(held, [ids, [(part << 32) + number] * n, [ids[lead]] * n, [n] * n, marks, [edge] * n, [sha] * n, texts], strict=True):
            to.extend(more)

    def flush():
        out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(held, kinds, strict=True)], names=names)
        for c in held:
            c.clear()
        return out

    for batch in batches:
        for norm, i, h in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if norm == text:
                ids.append(i)
                continue
            if text is None:
                first = mark = h
            else:
                close()
                number += 1
            if h != mark:
                settle(False)
                mark = h
                if len(held[0]) >= 8192:
                    yield flush()
            text, ids = norm, [i]
    if text is not None:
        close()
        settle(True)
        yield flush()


def groups_of_equals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None) -> DataFrame:
    """One row a document: id, keep_id, group_size, kept, text_sha256 (of the normalised text)."""
    spark = docs.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    source = docs.select(normalised(text_col).alias("norm"), F.col(id_col).cast("long").alias("id"))
    source = source.select("norm", "id", F.xxhash64("norm").alias("h"), F.substring("norm", 1, HEAD).alias("head"))
    placed = source.repartitionByRange(n, "head", "h", "id").sortWithinPartitions("head", "h", "norm", "id")
    rows = staged(placed.select("norm", "id", "h").mapInArrow(_runs, "id long, run long, run_min long, run_n long, lead boolean, edge boolean, sha string, edge_text string"))
    heads = rows.where("edge AND lead").select("edge_text", "run", "run_min", "run_n")
    whole = heads.groupBy("edge_text").agg(F.min("run_min").alias("g_min"), F.sum("run_n").alias("g_n"))
    both = heads.join(whole, "edge_text").select("edge_text", F.col("run").alias("e_run"), F.col("run_min").eqNullSafe(F.col("g_min")).alias("e_best"), "g_min", "g_n")
    # Of a group's runs the first with its smallest id has the row that stays.
    stays = both.where("e_best").groupBy("edge_text").agg(F.min("e_run").alias("g_run"))
    by_run = both.join(stays, "edge_text").select(F.col("e_run").alias("run"), "g_min", "g_n", "g_run")
    # Two rows of 40 bytes a partition at most, so a few MB at 100,000 partitions: this broadcast is bounded.
    out = rows.join(F.broadcast(by_run), "run", "left")
    return out.select(
        "id", F.coalesce("g_min", "run_min").alias("keep_id"), F.coalesce("g_n", "run_n").alias("group_size"),
        (F.col("lead") & (F.coalesce("g_run", "run") == F.col("run"))).alias("kept"), F.col("sha").alias("text_sha256"),
    )


def op3(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of documents."""
    return groups_of_equals(docs).withColumnRenamed("id", "doc_id")


#: The same rows in DuckDB; ids are unique there.
ORACLE = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents),
g AS (SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY norm)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256
FROM n JOIN g USING (norm)
"""
