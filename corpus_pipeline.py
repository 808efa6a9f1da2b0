"""From raw documents to packed training sequences: five stages, each written as Parquet before the next reads it.

Defined results, for every stage: null texts count as empty; rows without an id come after all rows with one and
are told apart, so each is decided by itself; rows that repeat an id, or an id and a text, are rows of their
own; an empty table gives no rows; extra columns pass through all stages but the last and clash with nothing,
unless they begin with two underscores. All stages but the last return the columns of their documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aspectdrift.llm import exact_dedup, mixing, packing, quality, simhash
from aspectdrift.llm.common import scratch_dir, staged

#: As many rows to leave out, 8 bytes each, are sent to all executors; more are joined by their key.
MOST_SENT = 2_000_000


def _keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs and a column that tells rows apart and sorts like their ids.

    That is doc_id itself where it does; otherwise rows are numbered in order of id, null ids last, and text.
    """
    ids = docs.agg(F.count("*"), F.count("doc_id"), F.count_distinct("doc_id")).first()
    if ids[0] == ids[1] == ids[2]:
        return docs, "doc_id"
    return staged(docs.orderBy(F.col("doc_id").asc_nulls_last(), F.sha2("text", 256)).withColumn("__row", F.monotonically_increasing_id())), "__row"


def _without(docs: DataFrame, key: str, dropped: DataFrame) -> DataFrame:
    """Rows of docs whose key isn't among dropped(key); texts only move where very many rows go."""
    gone = staged(dropped.select(F.col("key").alias("__gone")))
    gone = F.broadcast(gone) if gone.count() <= MOST_SENT else gone
    kept = docs.join(gone, F.col(key).cast("long") == F.col("__gone"), "left_anti")
    return kept.drop("__row")


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling selects; labels go by doc_id, ties of the last key are all kept."""
    docs, key = _keyed(docs)
    scored = quality.selected(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), row_col=key)
    return _without(docs, key, scored.where("NOT selected").select(F.col("row").alias("key")))


def exact_once(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of equal normalised texts the row with the smallest id."""
    docs, key = _keyed(docs)
    return _without(docs, key, exact_dedup.groups_of_equals(docs, key).where("NOT kept").select(F.col("id").alias("key")))


def near_once(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the row with the smallest id."""
    docs, key = _keyed(docs)
    return _without(docs, key, simhash.near_groups(docs, key).where("id <> component_id").select(F.col("id").alias("key")))


def to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it."""
    docs, key = _keyed(docs)
    return mixing.mixed(docs, key).drop("__row")


def to_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their sequence and offset, extra columns left out; a document taken twice has its pieces twice."""
    return packing.packed(docs, packing.default_tokenizer()).withColumnRenamed("id", "doc_id")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", good_quality),
    ("exact dedup", exact_once),
    ("near dedup", near_once),
    ("mixing", to_weights),
    ("packing", to_sequences),
]

#: Fits, draws and packings have no SQL form; the tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = scratch_dir(spark)
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        out.write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
