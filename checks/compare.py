"""Run queries and their SQL side by side: python -m checks.compare [folder] [name ...]"""

from __future__ import annotations

import math
import sys
import time
from collections import Counter

import duckdb
from pyspark.sql import DataFrame, SparkSession

from checks.oracle import ORACLE
from checks.queries import QUERIES

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages"
    " benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def normal(value):
    if isinstance(value, float) and math.isnan(value):
        return None
    return value


def rows(names: list[str], data) -> tuple[list[str], Counter]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], Counter(tuple(normal(r[i]) for i in order) for r in data)


def difference(df: DataFrame, con: duckdb.DuckDBPyConnection, sql: str) -> str:
    """Empty when both sides hold the same rows under the same names."""
    answer = con.execute(sql)
    names, want = rows([c[0] for c in answer.description], answer.fetchall())
    mine, got = rows(df.columns, df.collect())
    if mine != names:
        return f"columns differ: {sorted(set(mine) ^ set(names))}"
    if sum(got.values()) != sum(want.values()):
        return f"{sum(got.values())} rows, expected {sum(want.values())}"
    extra, missing = got - want, want - got
    if extra:
        a, b = sorted(extra, key=str)[0], sorted(missing, key=str)[0]
        cells = [(n, x, y) for n, x, y in zip(names, a, b) if x != y]
        return f"{sum(extra.values())} rows differ, first: {cells[:4]}"
    kinds = {
        n: (type(x), type(y))
        for n, x, y in zip(names, next(iter(got), ()), next(iter(want), ()))
        if type(x) is not type(y) and x is not None and y is not None
    }
    return f"types differ: {kinds}" if kinds else ""


def main() -> int:
    from tests.conftest import make_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(QUERIES)
    spark: SparkSession = make_session()
    con = connect(folder)
    bad = 0
    for name in names:
        start = time.time()
        if name not in ORACLE:
            outcome = f"{QUERIES[name](spark, folder).count()} rows, no SQL"
        else:
            try:
                outcome = difference(QUERIES[name](spark, folder), con, ORACLE[name]) or "same"
            except Exception as e:  # a report about all queries is wanted
                outcome = f"{type(e).__name__}: {str(e)[:600]}"
            bad += outcome != "same"
        print(f"{name:28} {time.time() - start:6.2f}s  {outcome}", flush=True)
    print(f"{bad} of {len(names)} differ")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
