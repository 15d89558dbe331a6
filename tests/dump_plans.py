"""Write PLANS.md: the physical plans of the headline queries (``explain('formatted')`` tree part).

python tests/dump_plans.py [sf_dir]
"""
from __future__ import annotations

import contextlib
import io
import os
import sys
import uuid

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from mailtriage.catalog import QUERIES  # noqa: E402
from mailtriage.session import AS_OF, build_session, checkpoint_dir  # noqa: E402
from mailtriage.sources import fixtures as fx  # noqa: E402
from mailtriage.sources import scans as SC  # noqa: E402

NOTES = {
    "triage_rules_only": "One stage up to the output: scan, filter, normalised inputs, the rule "
                         "Generate (evaluated once), routing. No exchange.",
    "rule_hit_counts": "Partial count per task before the only exchange.",
    "route_samples": "WindowGroupLimit keeps 5 rows per route and task before the shuffle.",
    "upsert_mail_labels": "Changes deduplicated by a partial max_by; the current table streams through a left join "
                          "with them (broadcast when small), new ids come from an anti join on the id column.",
    "upsert_feedback_latest": "Latest change per id by a partial max_by over the changes only, left-joined onto the "
                              "current table; new ids from an anti join.",
    "detect_changes": "One tagged pass; the lookups are small and broadcast by AQE when they fit.",
    "tfidf_subject": "In-row term counts, broadcast hash join to the bounded vocabulary, one window by id.",
    "review_queue": "Filters pushed below the join; TakeOrderedAndProject for the 100 rows.",
}


def tree(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    text = buf.getvalue()
    return text.split("\n\n\n")[0].strip()


def main(argv):
    sf = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    spark = build_session()
    parts = ["# Physical plans\n",
             f"Generated by `python tests/dump_plans.py {sf}` (AQE initial plans; the final plans may "
             "coalesce partitions or switch a join to broadcast at run time).\n"]
    for name, note in NOTES.items():
        parts.append(f"## {name}\n\n{note}\n\n```\n{tree(QUERIES[name](spark, sf))}\n```\n")
    path = f"{checkpoint_dir(spark)}/plans-mail-{uuid.uuid4().hex[:8]}"
    SC.write_mail_table(fx.raw_emails(spark, sf), path)
    df = SC.scan_inbox_window(spark.read.parquet(path), AS_OF).select("id", "received_at")
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    scan = [ln for ln in buf.getvalue().splitlines()
            if ln.startswith(("PartitionFilters", "PushedFilters", "ReadSchema"))]
    parts.append("## scan_inbox_window on a stored, day-partitioned mail table\n\n"
                 "The time window prunes day folders and is pushed into the Parquet reader; only "
                 "three columns are read.\n\n```\n" + "\n".join(scan) + "\n```\n")
    out = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "PLANS.md")
    with open(out, "w") as f:
        f.write("\n".join(parts))
    print(out)


if __name__ == "__main__":
    main(sys.argv)
