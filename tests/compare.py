"""Run a query in Spark and its SQL in DuckDB on the same tables, and compare names, types and values."""

from __future__ import annotations

import math
import sys
import time
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SAME_TYPE = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
    "timestamp": "TIMESTAMP", "date": "DATE", "smallint": "SMALLINT",
}


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return f"{value:.9g}"
    if isinstance(value, (int, str)) or value is None:
        return value
    return str(value)


def differences(df, con, sql: str, ordered: bool = False) -> list[str]:
    """Why the two results differ; empty when they agree."""
    names = sorted(df.columns)
    cursor = con.execute(sql)
    theirs = {c[0]: str(c[1]) for c in cursor.description}
    problems = []
    if names != sorted(theirs):
        return [f"columns {names} against {sorted(theirs)}"]
    kinds = dict(df.dtypes)
    for name in names:
        if SAME_TYPE.get(kinds[name]) != theirs[name]:
            problems.append(f"type of {name}: {kinds[name]} against {theirs[name]}")
    rows = cursor.fetchall()
    place = [[c[0] for c in cursor.description].index(n) for n in names]
    right = Counter(tuple(_plain(r[p]) for p in place) for r in rows)
    left = Counter(tuple(_plain(r[n]) for n in names) for r in df.collect())
    if left != right:
        problems.append(f"rows {sum(left.values())} against {sum(right.values())}")
        problems.append(f"only in Spark: {list((left - right).items())[:3]}")
        problems.append(f"only in SQL:   {list((right - left).items())[:3]} of {names}")
    elif not rows:
        problems.append("note: no rows")
    return problems


def main() -> None:
    sys.path.insert(0, "/root/repo")
    import __spark_entry__ as entry
    from coinweir.session import build_session

    spark = build_session("compare", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    queries, checks = entry.queries(), entry.oracle_sql()
    con = duck(folder)
    bad = 0
    for name, query in queries.items():
        if wanted and not any(name == w or (w.endswith("*") and name.startswith(w[:-1])) for w in wanted):
            continue
        start = time.time()
        try:
            df = query(spark, folder)
            if name in checks:
                problems = differences(df, con, checks[name])
                verdict = "ok" if not problems else "; ".join(problems)
            else:
                verdict = f"ok rows only: {df.count()}"
        except Exception as error:  # noqa: BLE001
            verdict = f"FAILED {type(error).__name__}: {str(error)[:600]}"
        if not verdict.startswith("ok"):
            bad += 1
        print(f"{name:28s} {time.time() - start:6.1f}s {verdict}", flush=True)
    print("not ok:", bad)


if __name__ == "__main__":
    main()
