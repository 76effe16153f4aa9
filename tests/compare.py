"""Side-by-side check of registered queries against their SQL on the same Parquet files.

Run as a script: python tests/compare.py [sf_dir] [query ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def duck(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET threads TO 8")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    return repr(value)


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(
        tuple(plain(row[i]) for i in order) for row in rows
    )


def compare(spark, con, name, query, sql, sf_dir):
    start = time.time()
    frame = query(spark, sf_dir)
    got_columns, got = table(frame.columns, [tuple(r) for r in frame.collect()])
    spent = f"spark {time.time() - start:.1f}s"
    if sql is None:
        return True, f"rows only: {len(got)}, {spent}"
    cursor = con.execute(sql)
    columns = [d[0] for d in cursor.description]
    want_columns, want = table(columns, cursor.fetchall())
    if got_columns != want_columns:
        return False, f"columns {got_columns} != {want_columns}"
    if len(got) != len(want):
        only_got = sorted(set(got) - set(want))[:2]
        only_want = sorted(set(want) - set(got))[:2]
        return False, f"rows {len(got)} != {len(want)}; spark {only_got}; sql {only_want}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        return False, f"{len(bad)} of {len(got)} rows differ, first: {got_columns} {bad[0]}"
    return True, f"{len(got)} rows, {spent}"


def main() -> int:
    import __spark_entry__ as entry
    from noticeworks.session import build_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark, con = build_session(), duck(sf_dir)
    failures = 0
    for name, query in entry.queries().items():
        if wanted and name not in wanted:
            continue
        start = time.time()
        try:
            good, note = compare(spark, con, name, query, entry.oracle_sql().get(name), sf_dir)
        except Exception as error:  # noqa: BLE001
            good, note = False, f"{type(error).__name__}: {str(error)[:600]}"
        failures += not good
        print(f"{'ok  ' if good else 'FAIL'} {name} ({time.time() - start:.1f}s) {note}", flush=True)
    print(f"{failures} failures")
    return 1 if failures else 0


if __name__ == "__main__":
    sys.exit(main())
