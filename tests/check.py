"""python tests/check.py [folder] [name start or @module ...]: compares registered queries with their SQL."""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import oracle as o  # noqa: E402

import costbook.plans  # noqa: E402, F401
from costbook.plans.registry import REGISTRY  # noqa: E402
from costbook.session import local_session  # noqa: E402

if __name__ == "__main__":
    folder = sys.argv[1]
    parts = sys.argv[2:]
    spark = local_session(8)
    con = o.connect(folder)
    bad = []
    for name, query in REGISTRY.items():
        module = query.run.__module__.rsplit(".", 1)[-1]
        if parts and not any(name.startswith(p) or p == f"@{module}" for p in parts):
            continue
        start = time.time()
        try:
            if query.sql is None:
                n = len(o.rows_of_spark(spark, folder, name)[2])
                message = None if n else "no rows"
                note = f"{n} rows, no sql"
            else:
                message = o.difference(spark, con, folder, name)
                note = "ok"
        except Exception as error:
            message = f"{type(error).__name__}: {str(error)[:700]}"
        took = time.time() - start
        if message:
            bad.append(name)
            print(f"FAIL {name} {took:.1f}s {message}", flush=True)
        else:
            print(f"{note:12} {name} {took:.1f}s", flush=True)
    print("failed:", bad)
