"""Run registered queries against their SQL in DuckDB: ``python tests/compare.py sf0.01 [names]``."""

from __future__ import annotations

import math
import os
import sys
import time
from collections import Counter
from decimal import Decimal

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def plain(value: object) -> object:
    if isinstance(value, Decimal):
        return float(value)
    if isinstance(value, float) and math.isnan(value):
        return "nan"
    return value


def rows(columns: list[str], records: list[tuple]) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in records)


def difference(spark, con, name: str, sf_dir: str) -> tuple[int, str]:
    """Row count and a description of the first difference (empty when equal)."""
    from __spark_entry__ import oracle_sql, queries

    df = queries()[name](spark, sf_dir)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    cursor = con.execute(oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    want = rows(names, cursor.fetchall())
    if sorted(df.columns) != sorted(names):
        return sum(got.values()), f"columns {sorted(df.columns)} != {sorted(names)}"
    extra, missing = got - want, want - got
    if extra or missing:
        return sum(got.values()), (
            f"{sum(extra.values())} extra, {sum(missing.values())} missing\n   spark {list(extra)[:2]}\n   duck  {list(missing)[:2]}"
        )
    return sum(got.values()), ""


if __name__ == "__main__":
    from __spark_entry__ import queries
    from cradlemart.session import build_session

    session = build_session(
        "compare", "local[8]",
        **{"spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.shuffle.partitions": "8"},
    )
    session.sparkContext.setLogLevel("ERROR")
    folder = f"/root/testdata/{sys.argv[1]}"
    connection, bad = duck(folder), 0
    for query in sys.argv[2:] or queries():
        t = time.time()
        try:
            n, text = difference(session, connection, query, folder)
        except Exception as e:  # noqa: BLE001
            n, text = 0, str(e)[:700]
        bad += bool(text)
        print(f"{query:24s} {time.time() - t:6.2f}s {n:8d} {'ok' if not text else 'DIFF ' + text}", flush=True)
    print("different:", bad)
