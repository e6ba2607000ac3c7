"""Compare registered queries with their DuckDB oracle.

    python check.py [folder] [name-prefix ...]
"""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET threads = 4")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, (int, decimal.Decimal, float)):
        number = float(value)
        return "nan" if math.isnan(number) else round(number, 6)
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    return str(value)


def ordered(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    lines = [tuple(plain(row[i]) for i in order) for row in rows]
    return [columns[i] for i in order], sorted(lines, key=repr)


def compare(spark, con, sf_dir: str, job, sql: str) -> str | None:
    """None when both sides agree, otherwise what differs."""
    df = job(spark, sf_dir)
    cols, got = ordered(df.columns, df.collect())
    reader = con.execute(sql)
    want_cols, want = ordered([d[0] for d in reader.description], reader.fetchall())
    if cols != want_cols:
        return f"columns {cols} != {want_cols}"
    if got != want:
        extra = sorted(set(got) - set(want), key=repr)[:2]
        missing = sorted(set(want) - set(got), key=repr)[:2]
        return f"{len(got)} rows against {len(want)}; only here {extra}; only there {missing}; {cols}"
    return None if got else "no rows"


def main() -> int:
    from gatelake import catalog
    from gatelake.catalog.registry import JOBS, ORACLES
    from gatelake.session import local_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    prefixes = tuple(sys.argv[2:])
    catalog.load()
    spark = local_session("8")
    con = connect(sf_dir)
    bad = 0
    for name, job in JOBS.items():
        if prefixes and not name.startswith(prefixes):
            continue
        start = time.time()
        try:
            if name in ORACLES:
                problem = compare(spark, con, sf_dir, job, ORACLES[name])
            else:
                problem = None if job(spark, sf_dir).count() else "no rows"
        except Exception as error:  # report and go on with the next query
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        kind = "sql " if name in ORACLES else "rows"
        print(f"{'ok  ' if problem is None else 'FAIL'} {kind} {time.time() - start:6.2f}s {name} {problem or ''}", flush=True)
        bad += problem is not None
    print(f"{bad} failed")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
