"""Every query with an oracle equals its DuckDB SQL (the driver's gate), here at sf0.001."""
from __future__ import annotations

import pytest

from mailtriage.catalog import ORACLE, QUERIES
from oracle_check import compare

from paths import SF_SMALL


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, duck, name):
    df = QUERIES[name](spark, SF_SMALL)
    assert compare(df, duck, ORACLE[name]) == []


HEAVY = {"train_gbt", "select_best", "train_job", "shadow_compare"}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE) - HEAVY))
def test_rows_only_query_runs(spark, name):
    df = QUERIES[name](spark, SF_SMALL)
    assert df.count() >= 0
    assert len(df.columns) > 0


def test_every_survey_key_is_registered():
    for key in ["scan_inbox_window", "apply_rules", "triage", "triage_rules_only", "triage_summary",
                "rule_hit_counts", "review_queue", "tfidf_subject", "stream_grace_expiry", "action_outbox"]:
        assert key in QUERIES
