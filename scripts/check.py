"""Run catalogue queries against their SQL twins: check.py [sf_dir] [name substring ...]."""
import math
import sys
import time
import traceback

import duckdb

sys.path.insert(0, __file__.rsplit("/", 2)[0])
from cytogrid.plans.catalog import ORACLE, QUERIES  # noqa: E402
from cytogrid.session import get_session  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


def key(row):
    return tuple((x is None, str(type(x)), str(x)) for x in row)


def main():
    args = sys.argv[1:]
    sf = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    names = [n for n in QUERIES if not args or any(a in n or (a[0] == '@' and QUERIES[n].__module__.endswith(a[1:])) for a in args)]
    spark = get_session("check", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    bad = 0
    for n in names:
        t0 = time.time()
        try:
            df = QUERIES[n](spark, sf)
            cols = sorted(df.columns)
            rows = [tuple(norm(v) for v in x) for x in df.select(*[f"`{c}`" for c in cols]).collect()]
            t1 = time.time()
            status = f"rows-only n={len(rows)}"
            if n in ORACLE:
                rel = con.sql(ORACLE[n])
                ocols = sorted(rel.columns)
                orel = con.sql("select " + ",".join(f'"{c}"' for c in ocols) + f" from ({ORACLE[n]})")
                orows = [tuple(norm(v) for v in x) for x in orel.fetchall()]
                if cols != ocols:
                    status = f"FAIL columns {cols} vs {ocols}"
                elif len(rows) != len(orows):
                    status = f"FAIL rows {len(rows)} vs {len(orows)}"
                else:
                    a, b = sorted(rows, key=key), sorted(orows, key=key)
                    diff = [(x, y) for x, y in zip(a, b) if x != y or [type(u) for u in x] != [type(u) for u in y]]
                    status = f"ok n={len(rows)}" if not diff else f"FAIL {len(diff)} differ e.g. {diff[0]}"
                    if not rows:
                        status += " EMPTY"
            print(f"{n:40s} {t1 - t0:6.2f}s sql {time.time() - t1:5.2f}s {status}", flush=True)
            bad += "FAIL" in status
        except Exception as e:
            bad += 1
            print(f"{n:40s} ERROR {type(e).__name__}: {str(e)[:600]}", flush=True)
            if len(names) < 4:
                traceback.print_exc()
    print("bad:", bad, "of", len(names))
    spark.stop()


main()
