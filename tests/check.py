"""Compare registered queries with their SQL counterparts on DuckDB.

Usage: python tests/check.py [sf_dir] [name ...]
"""

from __future__ import annotations

import datetime as dt
import math
import sys
import tempfile
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v


def rows_of(columns, data):
    at = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(norm(r[i]) for i in at) for r in data), key=repr)


def compare(spark, con, fn, sql, sf):
    df = fn(spark, sf)
    got = rows_of(df.columns, df.collect())
    rel = con.sql(sql)
    want_types = {c: str(t) for c, t in zip(rel.columns, rel.types)}
    got_types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    want = rows_of(rel.columns, rel.fetchall())
    problems = []
    if sorted(df.columns) != sorted(rel.columns):
        return [f"columns {sorted(df.columns)} / {sorted(rel.columns)}"], len(got)
    spelled = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}
    for c, t in got_types.items():
        if spelled.get(t, t) != want_types[c]:
            problems.append(f"type of {c}: {t} / {want_types[c]}")
    if len(got) != len(want):
        problems.append(f"rows {len(got)} / {len(want)}")
    if got != want:
        extra = [r for r in got if r not in set(want)][:3]
        missing = [r for r in want if r not in set(got)][:3]
        problems.append(f"values\n   only spark: {extra}\n   only sql:   {missing}")
    return problems, len(got)


def connect(sf):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def session(cores=8):
    from entityframe.session import builder

    spark = (
        builder("check").master(f"local[{cores}]")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="entityframe-"))
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    return spark


def main():
    import __spark_entry__ as entry

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:]
    spark, con = session(), connect(sf)
    oracles = entry.oracle_sql()
    bad = 0
    for name, fn in entry.queries().items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            if name in oracles:
                problems, n = compare(spark, con, fn, oracles[name], sf)
            else:
                problems, n = [], len(fn(spark, sf).collect())
        except Exception as e:  # noqa: BLE001
            problems, n = [f"{type(e).__name__}: {str(e)[:700]}"], 0
        bad += bool(problems)
        mark = "FAIL" if problems else ("ok" if name in oracles else "ok (no sql)")
        print(f"{mark:5} {name:36} rows={n:7} {time.time() - start:6.2f}s", flush=True)
        for p in problems:
            print("   ", p, flush=True)
    print(f"{bad} failing")


if __name__ == "__main__":
    main()
