"""Run registered queries next to their oracle SQL: ``python tests/compare.py [sf_dir] [name-prefix ...]``."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb
from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))


def session() -> SparkSession:
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def oracle(sf_dir: str):
    con = duckdb.connect()
    for f in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def norm(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, float):
        if math.isnan(value):
            return "NaN"
        return round(value, 9) + 0.0
    if isinstance(value, int):
        return float(value)
    if hasattr(value, "isoformat"):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(norm(v) for v in value)
    return str(value)


def table_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(
        (tuple(norm(r[i]) for i in order) for r in rows), key=lambda t: tuple((v is None, str(v)) for v in t)
    )


def compare(spark, con, sf_dir, name, fn, sql):
    """Return (ok, message)."""
    if sql is None:
        return False, "no oracle: nothing to compare"
    df = fn(spark, sf_dir)
    got_cols, got = table_of(df.columns, df.collect())
    cur = con.execute(sql)
    want_cols, want = table_of([d[0] for d in cur.description], cur.fetchall())
    if got_cols != want_cols:
        return False, f"columns {sorted(set(got_cols) ^ set(want_cols))}"
    if len(got) != len(want):
        return False, f"rows {len(got)} != {len(want)}"
    for a, b in zip(got, want):
        if a != b:
            bad = {c: (x, y) for c, x, y in zip(got_cols, a, b) if x != y}
            return False, f"first difference {bad} at {a[:4]}; {sum(x != y for x, y in zip(got, want))} of {len(got)}"
    return True, f"{len(got)} rows"


def main() -> int:
    import __spark_entry__ as entry

    args = sys.argv[1:]
    sf_dir = args.pop(0) if args and "/" in args[0] else "/root/testdata/sf0.01"
    queries, oracles = entry.queries(), entry.oracle_sql()
    spark, con = session(), oracle(sf_dir)
    failed = 0
    for name, fn in queries.items():
        if args and not any(name.startswith(a) for a in args):
            continue
        start = time.time()
        try:
            ok, message = compare(spark, con, sf_dir, name, fn, oracles.get(name))
        except Exception as exc:  # noqa: BLE001
            ok, message = False, f"{type(exc).__name__}: {str(exc)[:700]}"
        failed += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name:40s} {time.time() - start:6.2f}s {message}", flush=True)
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    raise SystemExit(main())
