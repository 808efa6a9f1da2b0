"""Compare queries with their DuckDB SQL: python tests/oracle.py SF_DIR [NAME...]."""

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def canon(value):
    if value is None or value != value:
        return "null"
    if isinstance(value, bool) or str(value) in ("True", "False"):
        return str(value)
    if isinstance(value, float):
        return f"{value + 0.0:.6f}"
    return str(value)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(canon(r[i]) for i in order) for r in rows)


def compare(spark, con, name, query, sql, sf_dir):
    """None if the rows agree, else what differs."""
    df = query(spark, sf_dir)
    got = rows_of(df.columns, df.collect())
    cur = con.execute(sql)
    want = rows_of([c[0] for c in cur.description], cur.fetchall())
    names = sorted(c[0] for c in cur.description)
    if sorted(df.columns) != names:
        return f"columns {sorted(df.columns)} and {names}"
    if len(got) != len(want):
        return f"{len(got)} and {len(want)} rows; first {got[:2]} and {want[:2]}"
    bad = [(a, b) for a, b in zip(got, want, strict=True) if a != b]
    return f"{len(bad)} of {len(got)} rows: {bad[:3]}" if bad else None


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.driver.memory", "6g").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    sf, names = sys.argv[1], sys.argv[2:]
    con, queries, oracle = duck(sf), entry.queries(), entry.oracle_sql()
    for name in names or queries:
        t = time.time()
        try:
            if name in oracle:
                said = compare(spark, con, name, queries[name], oracle[name], sf) or "ok"
            else:
                said = f"rows only: {len(queries[name](spark, sf).collect())}"
        except Exception as e:  # noqa: BLE001
            said = "ERROR " + str(e)[:700]
        print(f"{name}: {said} ({time.time() - t:.1f} s)", flush=True)
        spark.catalog.clearCache()
