"""Runs registered queries beside their SQL: ``python tests/oracle.py [names]``."""

from __future__ import annotations

import datetime
import decimal
import math
import os
import sys
import time

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(folder: str):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def _plain(value):
    if value is None:
        return None
    if isinstance(value, float) and math.isnan(value):
        return "nan"
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, (datetime.date, datetime.datetime)):
        return str(value)
    return value


def _sorted(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    plain = [tuple(_plain(row[i]) for i in order) for row in rows]
    return [names[i] for i in order], sorted(plain, key=repr)


def compare(df, con, sql):
    """None when both agree, otherwise what differs."""
    names, rows = _sorted(df.columns, [tuple(r) for r in df.collect()])
    result = con.execute(sql)
    onames, orows = _sorted([d[0] for d in result.description], result.fetchall())
    if names != onames:
        return f"columns {names} != {onames}"
    if len(rows) != len(orows):
        return f"{len(rows)} rows, SQL gives {len(orows)}"
    different = [(a, b) for a, b in zip(rows, orows) if repr(a) != repr(b)]
    if different:
        return f"{len(different)} rows differ, e.g. {different[0][0]} != {different[0][1]}"
    return None


def main() -> int:
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry
    from colgauge.session import build_session

    folder = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = build_session(master="local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false",
                          spark__driver__memory="12g", spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    queries, sql = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in sys.argv[1:] or queries:
        start = time.time()
        try:
            df = queries[name](spark, folder)
            if name in sql:
                problem = compare(df, con, sql[name])
                note = "ok" if problem is None else f"MISMATCH {problem}"
            else:
                note, problem = f"rows only: {len(df.collect())}", None
        except Exception as error:  # noqa: BLE001 - every query is reported
            problem = note = f"ERROR {str(error)[:700]}"
        bad += problem is not None
        print(f"{name:28s} {time.time() - start:6.2f}s {note}", flush=True)
    print(f"{bad} bad")
    return bad


if __name__ == "__main__":
    sys.exit(main())
