"""Run registered queries next to their SQL and compare the results.

Usage: python -m tests.compare SF_DIR [name ...]
"""

from __future__ import annotations

import math
import sys
import time

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def cell(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, float):
        return float(f"{value:.9g}") + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(cell(v) for v in value)
    if hasattr(value, "isoformat"):
        return value.isoformat()
    return value


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(cell(r[i]) for i in order) for r in rows), key=repr)


def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def run_spark(df):
    return canonical(df.columns, [tuple(r) for r in df.collect()])


def run_duck(con, sql):
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    return canonical(names, cur.fetchall())


def main(argv):
    import __spark_entry__ as entry
    from shelfgraph import get_spark

    sf_dir, wanted = argv[0], argv[1:]
    spark = get_spark("check", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
                                              "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con, queries, sqls, bad = duck(sf_dir), entry.queries(), entry.oracle_sql(), []
    names = [n for n in queries if not wanted or any(n == w or n.startswith(w) for w in wanted)]
    for name in names:
        t = time.time()
        try:
            df = queries[name](spark, sf_dir)
            got = run_spark(df)
            types = {f.name: f.dataType.simpleString() for f in df.schema}
            took = time.time() - t
            if name not in sqls:
                print(f"ROWS  {name} rows={len(got[1])} {took:.1f}s", flush=True)
                continue
            t = time.time()
            want = run_duck(con, sqls[name])
            sql_s = time.time() - t
            same = got == want
            print(f"{'ok   ' if same else 'DIFF '} {name} rows={len(got[1])}/{len(want[1])} {took:.1f}s sql {sql_s:.1f}s", flush=True)
            if not same:
                bad.append(name)
                print("   ", got[0], want[0], types)
                a, b = set(map(repr, got[1])), set(map(repr, want[1]))
                print("    spark only", sorted(a - b)[:3])
                print("    sql only  ", sorted(b - a)[:3])
        except Exception as e:  # report and go on with the next query
            bad.append(name)
            print(f"FAIL  {name}: {type(e).__name__} {str(e)[:600]}", flush=True)
    print("queries", len(names), "bad", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
