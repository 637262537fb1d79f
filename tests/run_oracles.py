"""``python tests/run_oracles.py [sf] [name part ...]``: every query against its SQL, with times."""

import os
import sys
import time
import traceback

sys.path[:0] = [os.path.dirname(os.path.dirname(os.path.abspath(__file__))), os.path.dirname(os.path.abspath(__file__))]

from oracle import compare, connect  # noqa: E402
from strataflow.plans.catalog import ORACLES, QUERIES  # noqa: E402
from strataflow.session import local_session  # noqa: E402

sf, parts = (sys.argv[1:2] or ["0.01"])[0], sys.argv[2:]
folder = f"/root/testdata/sf{sf}"
spark, con = local_session(), connect(folder)
bad = []
for name, fn in QUERIES.items():
    if parts and not any(p in name for p in parts):
        continue
    start = time.time()
    try:
        df = fn(spark, folder)
        if name in ORACLES:
            n, note = compare(df, con, ORACLES[name]), ""
        else:
            n, note = len(df.collect()), "(rows only)"
        print(f"ok   {name:45s} {n:8d} rows {time.time() - start:6.2f}s {note}", flush=True)
    except Exception as error:
        bad.append(name)
        text = str(error)
        if not isinstance(error, AssertionError):
            text = traceback.format_exc(limit=-3)[-1500:]
        print(f"BAD  {name:45s} {time.time() - start:6.2f}s {text[:1500]}", flush=True)
print("failed:", bad)
