"""Runs registered queries against their reference SQL in DuckDB and reports differences.

Usage: python tools/compare.py [folder] [name or module prefix ...]
"""

from __future__ import annotations

import math
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from swathline.plans import all_oracles, all_queries  # noqa: E402
from swathline.session import build_session  # noqa: E402
from swathline.sources.tables import NAMES  # noqa: E402


def plain(value):
    if isinstance(value, bool):
        return int(value)
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return value + 0.0
    return value


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], Counter(tuple(plain(r[i]) for i in order) for r in rows)


def connect(folder):
    con = duckdb.connect()
    for name in NAMES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def check(spark, con, folder, name, fn, oracle):
    began = time.time()
    df = fn(spark, folder)
    got_cols, got = canonical(df.columns, [tuple(r) for r in df.collect()])
    took = time.time() - began
    n = sum(got.values())
    if oracle is None:
        return f"rows  {n}", n > 0, took
    ref = con.execute(oracle)
    want_cols, want = canonical([d[0] for d in ref.description], ref.fetchall())
    if got_cols != want_cols:
        return f"COLUMNS {got_cols} != {want_cols}", False, took
    if got != want:
        extra, lost = list((got - want).items())[:3], list((want - got).items())[:3]
        return f"DIFF spark={n} duckdb={sum(want.values())}\n   only spark {extra}\n   only duckdb {lost}", False, took
    return f"ok    {n}", n > 0, took


def main(argv):
    folder = argv[0] if argv else "/root/testdata/sf0.01"
    wanted = argv[1:]
    spark = build_session(master="local[8]")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    oracles, bad = all_oracles(), []
    for name, fn in all_queries().items():
        module = fn.__module__.rsplit(".", 1)[1]
        if wanted and name not in wanted and module not in wanted:
            continue
        try:
            text, good, took = check(spark, con, folder, name, fn, oracles.get(name))
        except Exception as error:
            text, good, took = f"FAILED {type(error).__name__}: {str(error)[:600]}", False, 0.0
        if not good:
            bad.append(name)
        print(f"{took:6.1f}s {name:32s} {'' if good else '!! '}{text}", flush=True)
    print(f"{len(bad)} bad: {bad}")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
