"""Run registered queries against their SQL and report the differences.

    python tests/compare.py [--sf sf0.01] [name or name prefix ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def plain(v):
    if isinstance(v, float) and math.isnan(v):
        return "nan"
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    if isinstance(v, bytearray):
        return bytes(v)
    return v


def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(name, spark, con, sf_dir, queries, oracles, check=None):
    t0 = time.time()
    df = queries[name](spark, sf_dir)
    if check:
        check(df)
    got = rows_of(df.columns, df.collect())
    secs = time.time() - t0
    if name not in oracles:
        return f"rows-only {len(got)}", secs, None
    cur = con.execute(oracles[name])
    columns = [d[0] for d in cur.description]
    want = rows_of(columns, cur.fetchall())
    if sorted(columns) != sorted(df.columns):
        return "columns", secs, f"{sorted(df.columns)} != {sorted(columns)}"
    if got != want or [type(x) for r in got[:50] for x in r] != [type(x) for r in want[:50] for x in r]:
        bad = [(a, b) for a, b in zip(got, want) if a != b or list(map(type, a)) != list(map(type, b))][:2]
        return "values", secs, f"{len(got)} vs {len(want)} rows; {sorted(columns)} {bad}"
    return f"ok {len(got)}", secs, None


def main(argv):
    from __spark_entry__ import oracle_sql, queries
    from opsmetrics.session import build_session

    sf = "sf0.01"
    if "--sf" in argv:
        i = argv.index("--sf")
        sf = argv[i + 1]
        argv = argv[:i] + argv[i + 2:]
    sf_dir = f"/root/testdata/{sf}"
    spark = build_session("compare", "local[8]", **{"spark.sql.shuffle.partitions": "8",
                                                    "spark.ui.enabled": "false",
                                                    "spark.ui.showConsoleProgress": "false",
                                                    "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    qs, sql = queries(), oracle_sql()
    names = [n for n in qs if not argv or any(n == a or n.startswith(a) for a in argv)]
    failed = 0
    for n in names:
        try:
            status, secs, detail = compare(n, spark, con, sf_dir, qs, sql)
        except Exception as error:
            status, secs, detail = "error", 0.0, str(error)[:700]
        failed += detail is not None
        print(f"{n:34s} {secs:6.2f}s {status}" + (f"\n    {detail}" if detail else ""), flush=True)
    print(f"{len(names)} queries, {failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
