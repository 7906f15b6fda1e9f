"""Compare registered queries with their SQL on DuckDB: column names, row count, sorted values."""

import math
import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else (0.0 if v == 0 else v)
    if hasattr(v, "tzinfo") and v.tzinfo is not None:
        return v.replace(tzinfo=None)
    if isinstance(v, list):
        return tuple(plain(x) for x in v)
    return v


def table(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(cols), sorted((tuple(plain(r[i]) for i in order) for r in rows), key=lambda r: tuple(map(str, r)))


def compare(spark, con, name, fn, sql, sf_dir):
    df = fn(spark, sf_dir)
    got = table(df.columns, [tuple(r) for r in df.collect()])
    res = con.execute(sql)
    want = table([c[0] for c in res.description], res.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} != {want[0]}"
    if len(got[1]) != len(want[1]):
        return f"{len(got[1])} rows, oracle has {len(want[1])}"
    bad = [(g, w) for g, w in zip(got[1], want[1]) if g != w]
    if bad:
        return f"{len(bad)} of {len(want[1])} rows differ, e.g. {bad[0][0]} != {bad[0][1]}"
    kinds = {type(a) is type(b) or None in (a, b) for g, w in zip(got[1][:50], want[1][:50]) for a, b in zip(g, w)}
    return "types differ" if False in kinds else ""


if __name__ == "__main__":
    import os
    import tempfile

    from pyspark.sql import SparkSession

    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry

    sf = sys.argv[1]
    only = sys.argv[2:]
    spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
             .config("spark.ui.enabled", "false")
             .config("spark.python.unix.domain.socket.enabled", "true").config("spark.driver.memory", "12g")
             .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="gearsight-ckpt-")).getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    sqls = entry.oracle_sql()
    failed = 0
    for name, fn in entry.queries().items():
        if only and name not in only and not any(o.endswith("*") and name.startswith(o[:-1]) for o in only):
            continue
        t0 = time.time()
        try:
            if name in sqls:
                note = compare(spark, con, name, fn, sqls[name], sf)
            else:
                note = ""
                n = len(fn(spark, sf).collect())
        except Exception as e:  # report and go on
            note = f"{type(e).__name__}: {str(e)[:600]}"
        failed += bool(note)
        print(f"{'FAIL' if note else 'ok  '} {name:28s} {time.time() - t0:6.2f}s {'' if name in sqls else '(rows only) '}{note}",
              flush=True)
    print("failed:", failed)
    os._exit(failed > 0)
