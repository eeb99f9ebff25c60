"""CLI: compare registered queries with their oracles.  Usage:
python tests/run_oracle.py [sf_dir] [key ...]"""
import json
import sys
import time

sys.path.insert(0, "/root/repo")
sys.path.insert(0, "/root/repo/tests")

from oracle import compare, duck  # noqa: E402
import __spark_entry__  # noqa: E402
from spoofscope.session import get_session  # noqa: E402

sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
keys = sys.argv[2:]
QUERIES, ORACLES = __spark_entry__.queries(), __spark_entry__.oracle_sql()
spark = get_session("local[8]", 8)
con = duck(sf)
bad = 0
for k in keys or sorted(QUERIES):
    t = time.time()
    try:
        df = QUERIES[k](spark, sf)
        if k in ORACLES:
            r = compare(df, ORACLES[k], con)
        else:
            r = {"rows_only": df.count(), "ok": True}
    except Exception as e:  # noqa: BLE001
        r = {"ok": False, "error": repr(e)[:600]}
    r["sec"] = round(time.time() - t, 2)
    bad += not r.get("ok")
    print(k, json.dumps(r, default=str), flush=True)
    with open("/tmp/oracle_results.txt", "a") as fh:
        fh.write(k + " " + json.dumps(r, default=str)[:900] + "\n")
print("FAILED" if bad else "ALL OK", bad)
