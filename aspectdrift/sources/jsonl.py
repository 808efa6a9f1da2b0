"""JSON lines in and out, plain or gzipped, and small JSON reports."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_jsonl(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """Rows of one JSON object a line; .gz by its name, blank lines skipped, a malformed line is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_lookup(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """One whole JSON document, such as a report or a cohort list."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def write_jsonl(df: DataFrame, path: str, gzip: bool = True) -> int:
    """Write and count in one pass."""
    from pyspark.sql import Observation

    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").option("ignoreNullFields", False).json(path, compression="gzip" if gzip else "none")
    return int(seen.get["n"])


def write_report(report: DataFrame, path: str) -> None:
    """A result of a few rows as one JSON document, a list of objects, in the single file `path`; non-ASCII text is kept as it is."""
    rows = [json.loads(r) for r in report.toJSON().collect()]
    jvm = report.sparkSession.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(report.sparkSession.sparkContext._jsc.hadoopConfiguration()).create(where, True)
    out.write(bytearray(json.dumps(rows, ensure_ascii=False, indent=2).encode()))
    out.close()


def read_report(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """Rows of a report written by write_report."""
    return read_lookup(spark, path, schema)


def write_generated(units: DataFrame, generate: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str, path: str) -> int:
    """Write what a model makes of units, batch by batch as it runs, as gzipped JSON lines; returns the number of rows."""
    return write_jsonl(units.mapInPandas(generate, schema), path)


def with_line(df: DataFrame, start: int = 1, column: str = "line") -> DataFrame:
    """df with the number of each row, counted from start in order of partitions; a column of that name is replaced.

    Rows are numbered inside their partition, and partitions add the counts of those before them.
    """
    numbered = df.withColumn(column, F.monotonically_increasing_id())
    counts = numbered.groupBy(F.shiftright(column, 33).alias("__p")).agg(F.count("*").alias("__n"))  # a row a partition
    before = counts.select("__p", F.coalesce(F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    rows = numbered.join(F.broadcast(before), F.shiftright(column, 33) == F.col("__p"))
    return rows.withColumn(column, F.col(column).bitwiseAND(F.lit((1 << 33) - 1).cast("long")) + F.col("__before") + start).select(*[c for c in df.columns if c != column], column)


def head(df: DataFrame, n: int) -> DataFrame:
    """The first n rows in order of partitions; no more partitions are read than it takes."""
    return df.limit(n)


def images(spark: SparkSession, path: str) -> DataFrame:
    """Files with is_image, told by their first bytes."""
    from aspectdrift.operators.reliability import is_image

    return spark.read.format("binaryFile").load(path).withColumn("is_image", is_image(F.col("content")))


def save_model(spark: SparkSession, path: str, coefficients: list[float], intercept: float, features: list[str], verdict: str) -> None:
    """A model is one row: it carries its feature names and whether it may be used."""
    spark.createDataFrame([(coefficients, intercept, features, verdict)], "coefficients array<double>, intercept double, features array<string>, verdict string").write.mode("overwrite").parquet(path)


def load_model(spark: SparkSession, path: str, features: list[str]) -> tuple[list[float], float] | None:
    """The model, or None if its verdict is not GO; other features than expected are an error."""
    row = spark.read.parquet(path).first()
    if row.verdict != "GO":
        return None
    if list(row.features) != list(features):
        raise ValueError(f"the model was fitted on {row.features}, not {features}")
    return list(row.coefficients), row.intercept


def publish_model(spark: SparkSession, path: str, coefficients: list[float], intercept: float, features: list[str], verdict: str) -> str:
    """Save under `path` with GO; otherwise beside it, and take away what stood there, so no one uses it. Returns where it is."""
    if verdict == "GO":
        save_model(spark, path, coefficients, intercept, features, verdict)
        return path
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    save_model(spark, f"{path}.refused", coefficients, intercept, features, verdict)
    return f"{path}.refused"
