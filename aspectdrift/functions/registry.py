"""The column functions under names of their own for SQL. Bodies are SQL, so the planner sees through them: nothing runs in Python."""

from __future__ import annotations

from pyspark.sql import SparkSession

from aspectdrift import config

_SHORT, _MIDDLE = config.LENGTH_BINS
FUNCTIONS = {
    "length_bin(n INT) RETURNS STRING": f"CASE WHEN n < {_SHORT} THEN 'L0' WHEN n < {_MIDDLE} THEN 'L1' ELSE 'L2' END",
    "conf_band(c DOUBLE) RETURNS STRING": "CASE WHEN c < 0.6 THEN 'lo' WHEN c < 0.85 THEN 'mid' ELSE 'hi' END",
    "months_between_periods(a STRING, b STRING) RETURNS INT": "abs((int(substring(a, 1, 4)) - int(substring(b, 1, 4))) * 12 + int(substring(a, 6, 2)) - int(substring(b, 6, 2)))",
    "words_only(t STRING) RETURNS STRING": r"trim(regexp_replace(lower(coalesce(t, '')), '[^\\p{L}\\p{N}_]+', ' '))",
    "review_hash(t STRING) RETURNS STRING": r"md5(trim(regexp_replace(lower(coalesce(t, '')), '[^\\p{L}\\p{N}_]+', ' ')))",
    "stay_nights(t STRING) RETURNS INT": r"try_cast(nullif(regexp_extract(t, '(\\d+)[\\s\\u00a0]*đêm', 1), '') AS INT)",
    "quad_weight(w DOUBLE, conf DOUBLE) RETURNS DOUBLE": "coalesce(w, conf, 1.0D)",
}


def register(spark: SparkSession) -> list[str]:
    """Make all functions known to the session; returns their names."""
    for head, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    return [head.split("(")[0] for head in FUNCTIONS]
