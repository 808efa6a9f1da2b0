"""The queries of this subpackage, by name, and their DuckDB equivalents where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from aspectdrift.llm import embed_dedup, exact_dedup, lang_id, license_scan, mixing, packing, quality, secrets, simhash, warc


def _over(table: str, op: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: op(spark.read.parquet(f"{sf_dir}/{table}.parquet"))


def _op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.op5(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def _pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": _over("documents", lang_id.op1),
    "op2_source_mixing": _over("documents", mixing.op2),
    "op3_exact_dedup": _over("documents", exact_dedup.op3),
    "op4_packing": _over("documents", packing.op4),
    "op5_quality": _op5,
    "op6_license_scan": _over("documents", license_scan.op6),
    "op7_simhash_dedup": _over("documents", simhash.op7),
    "op8_embedding_dedup": _over("embeddings", embed_dedup.op8),
    "op9_secret_scan": _over("documents", secrets.op9),
    "op10_warc": _over("pages", warc.op10),
    "pipeline": _pipeline,
}

ORACLE_SQL: dict[str, str] = {"op3_exact_dedup": exact_dedup.ORACLE, "op9_secret_scan": secrets.ORACLE, "op10_warc": warc.ORACLE}
