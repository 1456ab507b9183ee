"""Compare registered queries with their SQL twins: ``python -m tests.oracle [sf] [name-part ...]``."""

from __future__ import annotations

import math
import sys
import time
from collections import Counter
from decimal import Decimal
from pathlib import Path

import duckdb
from pyspark.sql import DataFrame, SparkSession

import __spark_entry__ as driver

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def session(cores: int = 8) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("ledgerloom-checks")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def value(v: object) -> object:
    """Plain comparable form: whole-number types alike, floats as given, missing as None."""
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (int, Decimal)):
        return float(v) if isinstance(v, Decimal) else v
    return v


def rows_of_sql(sql: str, sf_dir: str) -> tuple[list[str], Counter]:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), Counter(tuple(value(r[i]) for i in order) for r in got.fetchall())


def rows_of_spark(df: DataFrame) -> tuple[list[str], Counter]:
    names = sorted(df.columns)
    return names, Counter(tuple(value(v) for v in r) for r in df.select(*[f"`{n}`" for n in names]).collect())


def difference(df: DataFrame, sql: str, sf_dir: str) -> str | None:
    ours, theirs = rows_of_spark(df), rows_of_sql(sql, sf_dir)
    if ours[0] != theirs[0]:
        return f"columns {ours[0]} != {theirs[0]}"
    if ours[1] != theirs[1]:
        more, less = ours[1] - theirs[1], theirs[1] - ours[1]
        return f"{sum(ours[1].values())} vs {sum(theirs[1].values())} rows; only here {list(more)[:3]}; only in SQL {list(less)[:3]}"
    return None if ours[1] else "no rows on either side"


def main(args: list[str]) -> int:
    sf = args[0] if args else "0.01"
    sf_dir = str(Path("/root/testdata") / f"sf{sf}")
    spark, bad = session(), 0
    oracles = driver.oracle_sql()
    for name, fn in driver.queries().items():
        if args[1:] and not any(a in name for a in args[1:]):
            continue
        start = time.time()
        try:
            df = fn(spark, sf_dir)
            problem = difference(df, oracles[name], sf_dir) if name in oracles else f"rows only: {df.count()}"
        except Exception as e:
            problem = f"{type(e).__name__}: {str(e)[:600]}"
        ok = problem is None or problem.startswith("rows only")
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name} {time.time() - start:.1f}s {problem or ''}", flush=True)
    print("failed:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
