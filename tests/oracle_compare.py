"""Runs a query and its SQL twin over the same tables and holds the rows against each other."""

from __future__ import annotations

import math
import os
import sys
from collections import Counter

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, list):
        return tuple(map(plain, v))
    return v


def duck_rows(sf_dir: str, sql: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(names), Counter(tuple(plain(r[i]) for i in order) for r in cur.fetchall())


def spark_rows(df):
    names = sorted(df.columns)
    return names, Counter(tuple(plain(v) for v in r) for r in df.select(*[f"`{c}`" for c in names]).collect())


def differences(df, sf_dir: str, sql: str) -> str:
    """Empty if both sides agree."""
    a_names, a = spark_rows(df)
    b_names, b = duck_rows(sf_dir, sql)
    if a_names != b_names:
        return f"columns {a_names} and {b_names}"
    if a == b:
        return ""
    return f"{a.total()} and {b.total()} rows; only here {list((a - b).items())[:3]}; only in SQL {list((b - a).items())[:3]}"


if __name__ == "__main__":
    import time

    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    os.environ["PYTHONPATH"] = sys.path[0] + os.pathsep + os.environ.get("PYTHONPATH", "")
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    sf = sys.argv[1]
    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("OFF")
    queries, twins = entry.queries(), entry.oracle_sql()
    for name in sys.argv[2:] or queries:
        t = time.time()
        try:
            df = queries[name](spark, sf)
            said = differences(df, sf, twins[name]) if name in twins else f"{df.count()} rows, no SQL"
        except Exception as e:
            said = f"{type(e).__name__}: {str(e)[:400]}"
        print(f"{name}: {said or 'equal'} ({time.time() - t:.1f} s)", flush=True)
