"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query is built and fully executed into Spark's ``noop`` sink (every row
computed, nothing collected); one warm-up run, then the median of
$BENCH_REPEATS runs. Prints ONE JSON line.
"""
from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "triage_rules_only", "triage_summary", "apply_rules", "rule_match_all", "ingest_messages",
    "upsert_mail_labels", "upsert_feedback_latest", "detect_changes", "derive_label", "tfidf_subject",
    "review_queue", "weekly_evaluation", "stream_triage",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeats = int(os.environ.get("BENCH_REPEATS", "3"))
    os.environ.setdefault("SHUFFLE_PARTITIONS", str(max(8, int(cpus) * 2)))
    from mailtriage.catalog import QUERIES
    from mailtriage.session import build_session
    spark = build_session(master=f"local[{cpus}]", app="mailtriage-bench")
    names = [n for n in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",") if n in QUERIES]
    times: dict[str, float] = {}
    rows: dict[str, int] = {}
    for name in names:
        runs = []
        for i in range(repeats + 1):
            t0 = time.perf_counter()
            df = QUERIES[name](spark, sf_dir)
            df.write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - t0)
        times[name] = round(statistics.median(runs[1:]), 3)
    sf = os.path.basename(sf_dir).replace("sf", "")
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(sf) if sf.replace(".", "").isdigit() else sf,
                      "cpus": int(cpus), "repeats": repeats}))


if __name__ == "__main__":
    main()
