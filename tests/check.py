"""Compare registered queries with their SQL on one scale factor (the driver's rule)."""
from __future__ import annotations

import math
import os
import signal
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


LIMIT = int(os.environ.get("QUERY_LIMIT", "60"))


def out_of_time(*_):
    raise TimeoutError(f"more than {LIMIT} s")


def connect(path):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{path}/{t}.parquet'")
    return con


def canon(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "~"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, (int, float)) or type(value).__name__ == "Decimal":
        return f"{float(value):.6f}".replace("-0.000000", "0.000000")
    return str(value)


def compare(spark, con, name, query, sql, path):
    t = time.time()
    df = query(spark, path)
    got = [tuple(r) for r in df.collect()]
    names = df.columns
    spark_s = time.time() - t
    if sql is None:
        return f"{name}: rows-only {len(got)} ({spark_s:.1f}s)", len(got) > 0
    t = time.time()
    rel = con.execute(sql)
    columns = [d[0] for d in rel.description]
    want = rel.fetchall()
    duck_s = time.time() - t
    head = f"{name}: spark {len(got)} in {spark_s:.1f}s, sql {len(want)} in {duck_s:.1f}s"
    if sorted(names) != sorted(columns):
        return f"{head} COLUMNS {sorted(set(names) ^ set(columns))}", False
    order_a = sorted(range(len(names)), key=lambda i: names[i])
    order_b = sorted(range(len(columns)), key=lambda i: columns[i])
    a = sorted(tuple(canon(r[i]) for i in order_a) for r in got)
    b = sorted(tuple(canon(r[i]) for i in order_b) for r in want)
    if a == b:
        return head + " ok", True
    bad = [i for i, (x, y) in enumerate(zip(a, b)) if x != y]
    detail = f"{head} DIFF {len(bad)} rows"
    if bad:
        x, y = a[bad[0]], b[bad[0]]
        detail += "\n   " + "\n   ".join(f"{sorted(names)[j]}: {p} | {q}" for j, (p, q) in enumerate(zip(x, y)) if p != q)[:1500]
    return detail, False


if __name__ == "__main__":
    import __spark_entry__ as entry
    from lockstep.session import local_session

    signal.signal(signal.SIGALRM, out_of_time)
    path = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    wanted = sys.argv[1:]
    spark, con = local_session(8), connect(path)
    queries, oracle = entry.queries(), entry.oracle_sql()
    failed = []
    for name, query in queries.items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        print("..", name, file=sys.stderr, flush=True)
        signal.alarm(LIMIT)
        try:
            message, ok = compare(spark, con, name, query, oracle.get(name), path)
        except Exception as exc:  # report and go on with the next query
            message, ok = f"{name}: ERROR {str(exc)[:1500]}", False
        signal.alarm(0)
        print(message, flush=True)
        if not ok:
            failed.append(name)
    print("failed:", failed)
