"""The star schema seen as weighted quads: one row a lineitem. See the README for the mapping."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PERIODS = ("1995-01", "2001-07")

#: The same view in DuckDB, for oracle queries.
SQL = """quads AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS review_uid, CAST(l_suppkey AS VARCHAR) AS hotel_id, strftime(o_orderdate, '%Y-%m') AS period,
         r_name AS bloc, c_mktsegment AS traveller, r_name || '|' || c_mktsegment AS stratum,
         p_type || '_' || (p_size % 5) AS taxonomy_code, p_type AS category, p_size % 5 < 3 AS reportable,
         CASE l_returnflag WHEN 'N' THEN 'positive' WHEN 'A' THEN 'neutral' ELSE 'negative' END AS sentiment,
         CASE l_linestatus WHEN 'O' THEN 'POS' ELSE 'NEG' END AS phi, 1 - l_discount AS w, 1 - l_tax AS conf_seq,
         p_name AS aspect_term, p_brand AS opinion_term, l_quantity AS n_words, l_extendedprice AS amount, l_linenumber AS line, l_partkey AS part
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey JOIN customer ON o_custkey = c_custkey
       JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  WHERE strftime(o_orderdate, '%Y-%m') BETWEEN '1995-01' AND '2001-07')"""


def quads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Join order is the planner's: dimensions are broadcast only under its size threshold; orders and lineitem shuffle once."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    place = read("nation").join(read("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name")
    who = read("customer").join(place, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "c_mktsegment", "r_name")
    period = F.date_format("o_orderdate", "yyyy-MM")
    first, last = (F.to_timestamp(F.lit(f"{p}-01")) for p in PERIODS)
    orders = read("orders").where((F.col("o_orderdate") >= first) & (F.col("o_orderdate") < F.add_months(last, 1))).select("o_orderkey", "o_custkey", period.alias("period"))
    orders = orders.join(who, F.col("o_custkey") == F.col("c_custkey"))
    rows = read("lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(read("part"), F.col("l_partkey") == F.col("p_partkey"))
    bucket = F.pmod(F.col("p_size"), F.lit(5))
    return rows.select(
        F.col("l_orderkey").cast("string").alias("review_uid"), F.col("l_suppkey").cast("string").alias("hotel_id"), "period",
        F.col("r_name").alias("bloc"), F.col("c_mktsegment").alias("traveller"), F.concat_ws("|", "r_name", "c_mktsegment").alias("stratum"),
        F.concat_ws("_", "p_type", bucket).alias("taxonomy_code"), F.col("p_type").alias("category"), (bucket < 3).alias("reportable"),
        F.when(F.col("l_returnflag") == "N", "positive").when(F.col("l_returnflag") == "A", "neutral").otherwise("negative").alias("sentiment"),
        F.when(F.col("l_linestatus") == "O", "POS").otherwise("NEG").alias("phi"),
        (1 - F.col("l_discount")).alias("w"), (1 - F.col("l_tax")).alias("conf_seq"), F.col("p_name").alias("aspect_term"), F.col("p_brand").alias("opinion_term"),
        F.col("l_quantity").alias("n_words"), F.col("l_extendedprice").alias("amount"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"),
    )
