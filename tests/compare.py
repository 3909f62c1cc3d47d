"""Compare registered Spark queries with their DuckDB oracle SQL.

Run: ``python -m tests.compare [sf_dir] [key ...]`` from the repository root.
Both results are normalised (columns sorted by name, values to canonical text, rows
sorted) and compared for row count, column names, types and values.
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import sys
import time

import duckdb
from pyspark.sql import types as T

from cuadro.session import TABLES

_SPARK_TO_DUCK = {
    T.LongType: "BIGINT", T.IntegerType: "INTEGER", T.DoubleType: "DOUBLE", T.FloatType: "FLOAT",
    T.StringType: "VARCHAR", T.BooleanType: "BOOLEAN", T.TimestampNTZType: "TIMESTAMP",
    T.DateType: "DATE", T.ShortType: "SMALLINT", T.ByteType: "TINYINT",
}


def spark_type_name(t: T.DataType) -> str:
    if isinstance(t, T.DecimalType):
        return f"DECIMAL({t.precision},{t.scale})"
    if isinstance(t, T.ArrayType):
        return spark_type_name(t.elementType) + "[]"
    for k, v in _SPARK_TO_DUCK.items():
        if isinstance(t, k):
            return v
    return t.simpleString().upper()


def canon(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "NaN"
        return repr(v + 0.0)
    if isinstance(v, decimal.Decimal):
        return format(v, "f")
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(canon(x) for x in v) + "]"
    if isinstance(v, dict):
        return "{" + ",".join(f"{k}:{canon(x)}" for k, x in sorted(v.items())) + "}"
    return str(v)


def normalise(columns: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(canon(r[i]) for i in order) for r in rows)


def duck_connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def compare(spark, sf_dir: str, key: str, query, sql: str | None, con=None) -> dict:
    t0 = time.time()
    sdf = query(spark, sf_dir)
    s_cols = sdf.columns
    s_types = [spark_type_name(f.dataType) for f in sdf.schema.fields]
    s_rows = [tuple(r) for r in sdf.collect()]
    out = {"key": key, "spark_rows": len(s_rows), "spark_sec": round(time.time() - t0, 2)}
    if sql is None:
        out["status"] = "rows-only"
        return out
    con = con or duck_connect(sf_dir)
    rel = con.execute(sql)
    d_cols = [d[0] for d in rel.description]
    d_rows = rel.fetchall()
    d_types = [str(d[1]) for d in rel.description]
    out["oracle_rows"] = len(d_rows)
    problems = []
    if sorted(s_cols) != sorted(d_cols):
        problems.append(f"columns {s_cols} vs {d_cols}")
    else:
        st = dict(zip(s_cols, s_types))
        dtp = dict(zip(d_cols, d_types))
        bad = {c: (st[c], dtp[c]) for c in s_cols if st[c] != dtp[c]}
        if bad:
            problems.append(f"types {bad}")
        a, b = normalise(s_cols, s_rows), normalise(d_cols, d_rows)
        if a != b:
            diff_a = [r for r in a if r not in set(b)][:3]
            diff_b = [r for r in b if r not in set(a)][:3]
            problems.append(f"values differ: spark-only {diff_a} oracle-only {diff_b}")
    out["status"] = "match" if not problems else "MISMATCH"
    if problems:
        out["problems"] = problems
    return out


def main(argv: list[str]) -> int:
    import os
    sys.path.insert(0, os.getcwd())
    import __spark_entry__ as E
    from cuadro.session import get_spark
    sf_dir = "/root/testdata/sf0.01"
    keys = []
    for a in argv:
        if a.startswith("/"):
            sf_dir = a
        else:
            keys.append(a)
    spark = get_spark("local[8]", shuffle_partitions=8)
    qs, orc = E.queries(), E.oracle_sql()
    con = duck_connect(sf_dir)
    failed = 0
    for k in keys or list(qs):
        try:
            r = compare(spark, sf_dir, k, qs[k], orc.get(k), con)
        except Exception as e:  # report and continue
            r = {"key": k, "status": "ERROR", "error": repr(e)[:600]}
        if r["status"] not in ("match", "rows-only"):
            failed += 1
        print(r, flush=True)
    print(f"{len(keys or qs) - failed} ok, {failed} failed")
    return 1 if failed else 0


if __name__ == "__main__":
    raise SystemExit(main(sys.argv[1:]))
