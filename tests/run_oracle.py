"""Compare registered queries with their SQL: ``python tests/run_oracle.py DIR [names...]``."""

import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entry  # noqa: E402
from modelshift.session import local_session  # noqa: E402
from tests.oracle import compare, connect  # noqa: E402


def main() -> int:
    sf_dir, names = sys.argv[1], sys.argv[2:]
    spark = local_session("8")
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = connect(sf_dir), 0
    queries, sql = entry.queries(), entry.oracle_sql()
    for name in names or queries:
        start = time.time()
        try:
            got = queries[name](spark, sf_dir).toArrow()
            took = time.time() - start
            if name not in sql:
                print(f"rows {name} {took:.1f}s {got.num_rows}", flush=True)
                continue
            problems = compare(got, con.sql(sql[name]).to_arrow_table())
        except Exception as e:
            problems, took = [f"{type(e).__name__}: {str(e)[:600]}"], time.time() - start
            if os.environ.get("TRACE"):
                traceback.print_exc()
        if problems:
            bad += 1
        print(f"{'FAIL' if problems else 'ok'} {name} {took:.1f}s", *problems, flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main())
