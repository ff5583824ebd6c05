"""Run registered queries against their SQL twins: python tests/compare.py [sf] [name ...]."""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def canonical(columns, rows):
    """Rows as sorted tuples of text, columns in name order; floats by value."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def cell(v):
        if v is None:
            return "\0"
        if isinstance(v, bool):
            return str(v)
        if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
            return repr(round(float(v), 6))
        return str(v)

    return [columns[i] for i in order], sorted(tuple(cell(r[i]) for i in order) for r in rows)


def compare(spark, con, fn, sql, sf_dir):
    df = fn(spark, sf_dir)
    got = canonical(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    want = canonical([d[0] for d in cur.description], cur.fetchall())
    return got, want


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import __spark_entry__ as E

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.001"
    only = sys.argv[2:]
    sf_dir = f"/root/testdata/sf{sf}"
    spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
             .config("spark.driver.memory", "8g").config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false").getOrCreate())
    spark.sparkContext.setLogLevel("OFF")
    con = duck(sf_dir)
    bad = []
    for name, fn in E.queries().items():
        if only and not any(name.startswith(o) for o in only):
            continue
        sql = E.oracle_sql().get(name)
        t = time.time()
        try:
            if sql is None:
                df = fn(spark, sf_dir)
                print(f"{name:45s} rows-only n={df.count()} {time.time() - t:.1f}s", flush=True)
                continue
            (gc, g), (wc, w) = compare(spark, con, fn, sql, sf_dir)
            ok = gc == wc and g == w
            print(f"{name:45s} {'ok ' if ok else 'BAD'} n={len(g)} want={len(w)} {time.time() - t:.1f}s", flush=True)
            if not ok:
                bad.append(name)
                print("   cols", gc, wc if gc != wc else "")
                print("   only got ", [x for x in g if x not in set(w)][:2])
                print("   only want", [x for x in w if x not in set(g)][:2])
        except Exception as exc:  # noqa: BLE001
            bad.append(name)
            print(f"{name:45s} ERROR {str(exc)[:700]}", flush=True)
    print("bad:", bad)
