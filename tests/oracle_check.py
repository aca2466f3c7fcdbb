"""Compare registry queries with their DuckDB oracles (row count, column
names, order-insensitive value hash). Usage:

    python tests/oracle_check.py [sf_dir] [name-prefix ...]

ORACLE_STRICT=1 compares floats bit for bit (default: rounded to 6
decimals); ORACLE_BARE=1 runs the queries in a plain SparkSession with
default settings, as an external driver would (ORACLE_BARE_MEM sets its
driver heap, default 16g).
"""

from __future__ import annotations

import hashlib
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


STRICT = bool(os.environ.get("ORACLE_STRICT"))


def norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return v if STRICT else round(v, 6)
    if hasattr(v, "item"):
        return norm(v.item())
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


def digest(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    lines = sorted(repr(tuple(norm(r[i]) for i in order)) for r in rows)
    return hashlib.sha1("\n".join(lines).encode()).hexdigest()


def main():
    import duckdb

    import __spark_entry__ as e
    from mensura.session import get_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    prefixes = sys.argv[2:]
    if os.environ.get("ORACLE_BARE"):  # a plain session, as an external driver would make
        from pyspark.sql import SparkSession
        spark = SparkSession.builder.master("local[8]").config("spark.driver.memory", os.environ.get("ORACLE_BARE_MEM", "16g")).getOrCreate()
    else:
        spark = get_session()
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    qs, sqls = e.queries(), e.oracle_sql()
    bad = 0
    for name, fn in sorted(qs.items()):
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        t0 = time.time()
        try:
            df = fn(spark, sf)
            rows = [tuple(r) for r in df.collect()]
            cols = df.columns
        except Exception as ex:  # noqa: BLE001
            bad += 1
            print(f"FAIL-SPARK {name}: {str(ex)[:300]}")
            continue
        dt = time.time() - t0
        if name not in sqls:
            print(f"rows-only  {name}: {len(rows)} rows {dt:.1f}s")
            continue
        try:
            cur = con.execute(sqls[name])
            ocols = [d[0] for d in cur.description]
            orows = cur.fetchall()
        except Exception as ex:  # noqa: BLE001
            bad += 1
            print(f"FAIL-SQL   {name}: {str(ex)[:300]}")
            continue
        ok_cols = sorted(cols) == sorted(ocols)
        ok_n = len(rows) == len(orows)
        ok_h = ok_cols and digest(cols, rows) == digest(ocols, orows)
        status = "ok" if (ok_cols and ok_n and ok_h) else "MISMATCH"
        if status != "ok":
            bad += 1
        print(f"{status:10s} {name}: spark {len(rows)} / sql {len(orows)} rows, "
              f"cols {'=' if ok_cols else (sorted(cols), sorted(ocols))}, "
              f"hash {'=' if ok_h else '!='} {dt:.1f}s")
    print(f"{bad} problems")
    spark.stop()


if __name__ == "__main__":
    main()
