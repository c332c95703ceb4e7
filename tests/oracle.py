"""Run registered queries against their checking SQL: ``python tests/oracle.py [--sf 0.01] [name ...]``."""

from __future__ import annotations

import argparse
import math
import os
import sys
import time
from decimal import Decimal
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


#: ``STRICT=1`` compares doubles bit by bit and tells 3 from 3.0.
STRICT = bool(os.environ.get("STRICT"))


def session(cores: int = 8):
    from pyspark.sql import SparkSession

    spark = (SparkSession.builder.master(f"local[{cores}]").appName("tidegauge")
             .config("spark.sql.shuffle.partitions", "8").config("spark.sql.session.timeZone", "UTC")
             .config("spark.driver.memory", "8g").config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def connect(folder: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def _plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, Decimal):
        value = float(value) if value % 1 else int(value)
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return (value if STRICT else round(value, 6)) + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    return value


def canonical(columns, rows):
    at = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in at], sorted((tuple(_plain(r[i]) for i in at) for r in rows), key=repr)


def compare(spark, con, name, fn, sql, folder):
    start = time.time()
    df = fn(spark, folder)
    got = canonical(df.columns, [tuple(r) for r in df.collect()])
    took = time.time() - start
    if sql is None:
        return True, f"{len(got[1])} rows, no oracle", took
    con.execute(sql)
    want = canonical([d[0] for d in con.description], con.fetchall())
    if got[0] != want[0]:
        return False, f"columns {got[0]} != {want[0]}", took
    if got[1] != want[1] or (STRICT and list(map(repr, got[1])) != list(map(repr, want[1]))):
        mine, theirs = set(map(repr, got[1])), set(map(repr, want[1]))
        return False, (f"rows {len(got[1])} vs {len(want[1])}\n   cols {got[0]}\n   spark only "
                       f"{sorted(mine - theirs)[:3]}\n   oracle only {sorted(theirs - mine)[:3]}"), took
    return True, f"{len(got[1])} rows", took


def main() -> None:
    args = argparse.ArgumentParser()
    args.add_argument("names", nargs="*")
    args.add_argument("--sf", default="0.01")
    args.add_argument("--group-rows")
    args.add_argument("--module")
    opts = args.parse_args()
    folder = f"/root/testdata/sf{opts.sf}"
    import __spark_entry__ as entry

    spark = session()
    if opts.group_rows:
        spark.conf.set("tidegauge.groupRows", opts.group_rows)
    con = connect(folder)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, fn in queries.items():
        if opts.names and name not in opts.names:
            continue
        if opts.module and not fn.__module__.endswith(opts.module):
            continue
        try:
            ok, note, took = compare(spark, con, name, fn, oracles.get(name), folder)
        except Exception as error:  # noqa: BLE001 - report and go on to the next query
            ok, note, took = False, f"{type(error).__name__}: {str(error)[:1500]}", 0.0
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name:28s} {took:6.2f}s {note}", flush=True)
    print(f"{bad} failing")


if __name__ == "__main__":
    main()
