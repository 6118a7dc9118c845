"""Compare a query with its SQL twin, order of rows and columns ignored."""

from __future__ import annotations

import math
import sys
import time
from collections import Counter
from decimal import Decimal

import duckdb
from pyspark.sql import SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, Decimal):
        value = float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    return repr(value)


def difference(spark: SparkSession, con, build, sql: str, folder: str) -> str | None:
    """None when both sides give the same bag of rows, else what differs."""
    df = build(spark, folder)
    names = sorted(df.columns)
    got = Counter(tuple(_plain(r[n]) for n in names) for r in df.collect())
    result = con.execute(sql)
    columns = [d[0] for d in result.description]
    if sorted(columns) != names:
        return f"columns {names} vs {sorted(columns)}"
    at = [columns.index(n) for n in names]
    want = Counter(tuple(_plain(r[i]) for i in at) for r in result.fetchall())
    if got == want:
        return None
    extra, missing = got - want, want - got
    return (
        f"{sum(got.values())} vs {sum(want.values())} rows, {sum(extra.values())} differ\n  columns {names}"
        f"\n  spark {list(extra)[:2]}\n  sql   {list(missing)[:2]}"
    )


def main(folder: str, *wanted: str) -> None:
    from .all import ORACLE, QUERIES

    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.python.sql.dataFrameDebugging.enabled", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    bad = 0
    for name, build in QUERIES.items():
        if wanted and not any(w in name for w in wanted):
            continue
        start = time.time()
        try:
            if name in ORACLE:
                problem = difference(spark, con, build, ORACLE[name], folder)
            else:
                problem = None
                print(f"     {name}: {build(spark, folder).count()} rows, no twin", flush=True)
        except Exception as failure:  # noqa: BLE001 - report and go on with the next query
            problem = f"{type(failure).__name__}: {str(failure)[:1200]}"
        bad += problem is not None
        print(f"{'ok  ' if problem is None else 'BAD '} {name} {time.time() - start:.1f}s" + (f"\n  {problem}" if problem else ""), flush=True)
    print(f"{bad} bad")


if __name__ == "__main__":
    main(*sys.argv[1:])
