"""Runs queries against their SQL in DuckDB: python tests/compare.py SF_DIR [NAME...]"""

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings payments evaluations risk_rules late_events source_targets".split()


def norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if hasattr(v, "as_tuple"):
        return round(float(v), 6)
    return v


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in rows), key=repr)


def duck(sf_dir):
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in TABLES:
        p = Path(sf_dir, f"{t}.parquet")
        if p.exists():
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}{'/*.parquet' if p.is_dir() else ''}')")
    return c


def compare(spark, sf_dir, name, query, sql, conn):
    t = time.time()
    df = query(spark, sf_dir)
    got = rows_of(df.columns, df.collect())
    took = time.time() - t
    if sql is None:
        return True, f"{name}: {len(got)} rows, no SQL, {took:.1f} s"
    cur = conn.execute(sql)
    cols = [x[0] for x in cur.description]
    want = rows_of(cols, cur.fetchall())
    if sorted(cols) != sorted(df.columns):
        return False, f"{name}: columns {sorted(df.columns)} against {sorted(cols)}"
    if got != want:
        g, w = set(got), set(want)
        return False, f"{name}: {len(got)} rows against {len(want)}; only here {sorted(g - w, key=repr)[:3]}, only there {sorted(w - g, key=repr)[:3]}"
    return True, f"{name}: {len(got)} rows agree, {took:.1f} s"


if __name__ == "__main__":
    import __spark_entry__ as e
    from ledgerlens.session import local_session

    spark, conn = local_session(), duck(sys.argv[1])
    qs, sqls = e.queries(), e.oracle_sql()
    bad = 0
    for n in sys.argv[2:] or qs:
        try:
            ok, said = compare(spark, sys.argv[1], n, qs[n], sqls.get(n), conn)
        except Exception as x:
            ok, said = False, f"{n}: {type(x).__name__} {str(x)[:1500]}"
        bad += not ok
        print("ok  " if ok else "FAIL", said, flush=True)
    print("failed:", bad)
    spark.stop()
