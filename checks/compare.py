"""Run queries next to their SQL and report differences.

    python -m checks.compare [sf_dir] [key ...]
"""

from __future__ import annotations

import sys
import time

import duckdb

from checks.oracle import ORACLE
from checks.queries import QUERIES
from playcohort import build_session

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def local_session():
    spark = build_session(
        "checks",
        "local[8]",
        {
            "spark.sql.shuffle.partitions": "8",
            "spark.ui.enabled": "false",
            "spark.driver.memory": "12g",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def canon(rows: list[tuple], names: list[str]) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(r[i] for i in order) for r in rows), key=repr)


def difference(spark, con, key: str, sf: str) -> tuple[str | None, float]:
    """What differs between a query and its statement (None: nothing), and the seconds."""
    start = time.time()
    df = QUERIES[key](spark, sf)
    got = [tuple(r) for r in df.collect()]
    took = time.time() - start
    if key not in ORACLE:
        return (None if got else "no rows"), took
    cur = con.execute(ORACLE[key])
    names = [d[0] for d in cur.description]
    want = cur.fetchall()
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(names)}", took
    a, b = canon(got, df.columns), canon(want, names)
    if len(a) != len(b):
        return f"{len(a)} rows != {len(b)}", took
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        return f"{len(bad)} of {len(a)} rows differ, e.g. {bad[0][0]} != {bad[0][1]}", took
    return None, took


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    keys = sys.argv[2:] or list(QUERIES)
    spark, con = local_session(), connect(sf)
    failed = 0
    for key in keys:
        try:
            bad, took = difference(spark, con, key, sf)
        except Exception as exc:  # noqa: BLE001
            bad, took = f"{type(exc).__name__}: {str(exc)[:600]}", 0.0
        failed += bad is not None
        mark = "ok  " if bad is None else "FAIL"
        print(f"{mark} {key} {took:.2f}s {'' if key in ORACLE else '(rows only) '}{bad or ''}", flush=True)
    print(f"{len(keys) - failed} of {len(keys)} agree", flush=True)


if __name__ == "__main__":
    main()
