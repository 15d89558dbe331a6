"""Run every registered query against its oracle SQL: python tests/run_oracle.py [sf_dir] [name...]"""
from __future__ import annotations

import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from oracle_check import TIMES, compare, duck_connect  # noqa: E402

from mailtriage.catalog import ORACLE, QUERIES  # noqa: E402
from mailtriage.session import build_session  # noqa: E402


def main(argv):
    sf = argv[1] if len(argv) > 1 and argv[1].startswith("/") else "/root/testdata/sf0.01"
    names = [a for a in argv[1:] if not a.startswith("/")] or sorted(QUERIES)
    spark = build_session(shuffle_partitions=8)
    con = duck_connect(sf)
    bad = 0
    for name in names:
        t0 = time.time()
        try:
            df = QUERIES[name](spark, sf)
            if name in ORACLE:
                probs = compare(df, con, ORACLE[name])
                n = len(df.columns)
            else:
                cnt = df.count()
                probs, n = [], cnt
            status = "OK " if not probs else "BAD"
            kind = (f"oracle spark={TIMES['spark']:.2f}s duck={TIMES['duck']:.2f}s" if name in ORACLE
                    else f"rows-only ({n} rows)")
        except Exception as e:  # noqa: BLE001
            probs, status, kind = [f"{type(e).__name__}: {str(e)[:800]}"], "ERR", ""
            traceback.print_exc()
        bad += status != "OK "
        print(f"{status} {name:<32} {time.time()-t0:6.2f}s {kind} {' | '.join(probs)[:1500]}", flush=True)
    print(f"{len(names)-bad}/{len(names)} ok")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv))
