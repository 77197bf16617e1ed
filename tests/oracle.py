"""Compare registered queries with their SQL: python tests/oracle.py [sf_dir] [name prefix ...]"""

from __future__ import annotations

import decimal
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def session():
    from pyspark.sql import SparkSession

    spark = (SparkSession.builder.master("local[8]").appName("checks")
             .config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "8")
             .config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC")
             .config("spark.ui.showConsoleProgress", "false").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def database(sf: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def cell(v):
        if v is None:
            return "~"
        if isinstance(v, bool):
            return str(v)
        if isinstance(v, decimal.Decimal):
            v = float(v)
        if isinstance(v, float):
            return "nan" if math.isnan(v) else repr(v)
        return str(v)

    return sorted(tuple(cell(r[i]) for i in order) for r in rows), [columns[i] for i in order]


def compare(spark, con, name: str, query, sql: str, sf: str):
    """Returns an error text, or None when rows, names and values agree."""
    df = query(spark, sf)
    got, got_cols = canonical([tuple(r) for r in df.collect()], df.columns)
    cur = con.execute(sql)
    want, want_cols = canonical(cur.fetchall(), [d[0] for d in cur.description])
    if got_cols != want_cols:
        return f"columns {got_cols} != {want_cols}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    kinds = {c: t for c, t in df.dtypes}
    sql_kinds = {d[0]: str(d[1]) for d in cur.description}
    loose = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE", "boolean": "BOOLEAN"}
    odd = [c for c in kinds if loose.get(kinds[c]) != sql_kinds[c]]
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        return f"{len(bad)} of {len(got)} rows differ, first {bad[0]}"
    return f"types {[(c, kinds[c], sql_kinds[c]) for c in odd]}" if odd else None


if __name__ == "__main__":
    import __spark_entry__ as entry

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    prefixes = tuple(sys.argv[2:])
    spark, con = session(), database(sf)
    sqls, failed = entry.oracle_sql(), []
    for name, q in entry.queries().items():
        if prefixes and not name.startswith(prefixes):
            continue
        start = time.time()
        try:
            if name in sqls:
                err = compare(spark, con, name, q, sqls[name], sf)
            else:
                err = None if q(spark, sf).count() > 0 else "no rows"
        except Exception as exc:
            err = f"{type(exc).__name__}: {str(exc)[:900]}"
        print(f"{'ok  ' if err is None else 'FAIL'} {time.time() - start:6.1f}s {name}{'' if name in sqls else ' (rows only)'} {err or ''}", flush=True)
        if err:
            failed.append(name)
    print(f"{len(failed)} failed: {failed}")
