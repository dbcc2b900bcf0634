"""python tests/check_queries.py [sf] [name ...] — run queries against their SQL twins and print the result."""

import sys
import traceback

sys.path.insert(0, __file__.rsplit("/", 2)[0])

import __spark_entry__ as entry  # noqa: E402
from ledgerspark.session import build_session  # noqa: E402
from tests.oracle import compare, connect  # noqa: E402

if __name__ == "__main__":
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    wanted = sys.argv[2:]
    sf_dir = f"/root/testdata/sf{sf}"
    spark = build_session("check", 8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    queries, sqls = entry.queries(), entry.oracle_sql()
    failed = 0
    for name, fn in queries.items():
        if wanted and not any(name == w or (w.endswith("*") and name.startswith(w[:-1])) for w in wanted):
            continue
        try:
            res = compare(spark, con, sf_dir, fn, sqls.get(name))
        except Exception as exc:
            traceback.print_exc(limit=3)
            res = {"ok": False, "note": repr(exc)[:600], "rows": -1, "sec": 0}
        failed += not res["ok"]
        tag = "ok  " if res["ok"] else "FAIL"
        print(f"{tag} {name:32s} rows={res['rows']:<8} {res['sec']:6.2f}s {'sql' if name in sqls else 'rows-only'} {res['note']}", flush=True)
    print(f"failed: {failed}")
