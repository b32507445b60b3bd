"""Compare queries with their SQL: python tests/check.py [name part ...]"""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import __spark_entry__ as e
import oracle
from runlens.session import local_session

if __name__ == "__main__":
    sf = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = oracle.connect(sf)
    wanted = sys.argv[1:]
    for name, fn in e.queries().items():
        if wanted and not any(w in name for w in wanted):
            continue
        t = time.time()
        try:
            sql = e.oracle_sql().get(name)
            if sql is None:
                rows = len(fn(spark, sf).collect())
                print(f"rows {name} {rows} {time.time() - t:.1f}s", flush=True)
            else:
                diff = oracle.compare(spark, name, fn, sql, sf, con)
                print(f"{'ok  ' if diff is None else 'DIFF'} {name} {time.time() - t:.1f}s {diff or ''}"[:1200], flush=True)
        except Exception as ex:
            print(f"ERR  {name} {type(ex).__name__}: {str(ex)[:700]}", flush=True)
