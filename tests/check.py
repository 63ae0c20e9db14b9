"""Command line: python tests/check.py sf0.01 [name-prefix ...]  compares registered queries with DuckDB."""

import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import __spark_entry__ as e
from gatewright.session import local_session
from parity import compare, duck


def main():
    sf, prefixes = sys.argv[1], tuple(sys.argv[2:])
    sf_dir = f"/root/testdata/{sf}"
    spark, con, sqls = local_session(), duck(sf_dir), e.oracle_sql()
    bad = 0
    for name, fn in e.queries().items():
        if prefixes and not name.startswith(prefixes):
            continue
        start = time.time()
        try:
            df = fn(spark, sf_dir)
            if name in sqls:
                result = compare(df, con, sqls[name])
                n = con.execute(f"SELECT count(*) FROM ({sqls[name]})").fetchone()[0] if not result else "-"
            else:
                result, n = None, f"rows-only {df.count()}"
        except Exception as ex:
            result, n = "".join(traceback.format_exception_only(ex))[:1500], "-"
        bad += bool(result)
        print(f"{'OK  ' if not result else 'FAIL'} {name} {time.time() - start:.2f}s rows={n} {result or ''}", flush=True)
    print("failures:", bad)


main()
