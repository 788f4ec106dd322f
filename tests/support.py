"""Run queries against their SQL; also ``python -m tests.support SF [name ...]``."""

from __future__ import annotations

import os
import sys
import time
from collections import Counter

import duckdb
from pyspark.sql import SparkSession

import __spark_entry__ as entry

DATA = os.environ.get("DOCMARK_TESTDATA", "/root/testdata")
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations").split()


def session(cores: str = "8") -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cores}]").appName("docmark-tests")
        .config("spark.sql.shuffle.partitions", os.environ.get("TEST_PARTITIONS", "4"))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate())


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float) and value == int(value):
        return int(value)
    return value


def _bag(columns: list[str], rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_plain(r[i]) for i in order) for r in rows)


def differences(spark: SparkSession, con, name: str, sf_dir: str) -> list[str]:
    """What differs between a query and its SQL; empty when nothing does."""
    df = entry.queries()[name](spark, sf_dir)
    got = df.collect()
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return [] if df.columns else ["no columns"]
    rel = con.execute(sql)
    columns = [d[0] for d in rel.description]
    want = rel.fetchall()
    if sorted(columns) != sorted(df.columns):
        return [f"columns {sorted(df.columns)} against {sorted(columns)}"]
    a, b = _bag(df.columns, got), _bag(columns, want)
    out = []
    if len(got) != len(want):
        out.append(f"rows {len(got)} against {len(want)}")
    if a != b:
        out.append(f"spark only: {[(k, n) for k, n in (a - b).items()][:2]!r}"[:700])
        out.append(f"duckdb only: {[(k, n) for k, n in (b - a).items()][:2]!r}"[:700])
    return out


def main(sf: str, names: list[str]) -> int:
    sf_dir = f"{DATA}/sf{sf}"
    spark, con = session(), duck(sf_dir)
    spark.sparkContext.setLogLevel("ERROR")
    bad = 0
    for name in names or entry.queries():
        t = time.time()
        try:
            diff = differences(spark, con, name, sf_dir)
        except Exception as exc:  # report and go on with the next query
            diff = [f"{type(exc).__name__}: {str(exc)[:600]}"]
        bad += bool(diff)
        print(f"{'FAIL' if diff else 'ok  '} {name} {time.time() - t:.1f}s", flush=True)
        for line in diff:
            print("     ", line, flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1], sys.argv[2:]) else 0)
