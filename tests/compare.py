"""Compare every registered query with its SQL oracle: `python tests/compare.py [folder] [names...]`."""

from __future__ import annotations

import os
import signal
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations").split()


def oracle_connection(folder: str):
    import duckdb

    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return connection


def _cell(value) -> str:
    import math

    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "NULL"
    if isinstance(value, float):
        return format(value, ".9g")
    return str(value)


def _rows(table) -> tuple[list[str], list[tuple]]:
    names = sorted(table.column_names)
    columns = [table.column(n).to_pylist() for n in names]
    return names, sorted(tuple(_cell(v) for v in row) for row in zip(*columns)) if names else []


def differences(spark, connection, folder: str, name: str, fn, sql: str) -> str | None:
    """None when the query and its oracle agree, else what differs."""
    got_table = fn(spark, folder).toArrow()
    want_table = connection.execute(sql).to_arrow_table()
    kinds = lambda t: {f.name: str(f.type).replace("large_", "") for f in t.schema}
    if kinds(got_table) != kinds(want_table):
        odd = {k: (kinds(got_table).get(k), kinds(want_table).get(k))
               for k in kinds(got_table) | kinds(want_table) if kinds(got_table).get(k) != kinds(want_table).get(k)}
        return f"columns differ: {odd}"
    (_, got), (_, want) = _rows(got_table), _rows(want_table)
    if got != want:
        extra, missing = sorted(set(got) - set(want))[:2], sorted(set(want) - set(got))[:2]
        return f"rows {len(got)} against {len(want)}; only here {extra}; only in oracle {missing}"[:1500]
    return None if got else "EMPTY"


LIMIT = 60  # seconds per query


def _too_slow(*_) -> None:
    raise TimeoutError(f"no result within {LIMIT} s")


def main() -> None:
    signal.signal(signal.SIGALRM, _too_slow)
    from __spark_entry__ import oracle_sql, queries
    from quillflow import build_session

    args = sys.argv[1:]
    folder = args[0] if args else "/root/testdata/sf0.01"
    spark = build_session(
        "compare", master="local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false", spark__driver__memory="8g")
    spark.sparkContext.setLogLevel("ERROR")
    connection, oracles = oracle_connection(folder), oracle_sql()
    bad = 0
    for name, fn in queries().items():
        if len(args) > 1 and name not in args[1:]:
            continue
        start = time.time()
        signal.alarm(LIMIT)
        try:
            if name in oracles:
                problem = differences(spark, connection, folder, name, fn, oracles[name])
            else:
                problem = None if fn(spark, folder).count() else "EMPTY"
        except Exception as e:
            problem = f"{type(e).__name__}: {str(e)[:1200]}"
        signal.alarm(0)
        spark.sparkContext.cancelAllJobs()
        bad += problem is not None
        print(f"{'ok  ' if problem is None else 'FAIL'} {name} {time.time() - start:.1f}s {problem or ''}", flush=True)
    print("failures:", bad)


if __name__ == "__main__":
    main()
