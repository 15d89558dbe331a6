"""Set-based table changes (K1-K14), checks (V1-V5) and foreign keys.

Plain Parquet tables have no MERGE/UPDATE, so every change is a pure function
``(current, changes) -> new snapshot`` that the caller writes once as a new
version (``commit.Store``). On a table format with MERGE support the same
semantics can be expressed with ``DataFrame.mergeInto``.

Shape of every upsert: one shuffle on the key (a join or a ``groupBy`` with
``max_by`` / ``min_by``, which aggregates partially before the shuffle). No
window sorts, no driver round trips. When the current table is bucketed by
the key the shuffle of the big side disappears.
"""
from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.packs import DECISION_VALUES, FINAL_STATES, HUMAN_SOURCES, OUTBOX_GROUP_SIZE, USER_LABELS
from ..session import AS_OF


def _dedupe_first(df: DataFrame, key: str, order: Column) -> DataFrame:
    """One row per key: the row with the smallest ``order`` (equal orders: the smallest row), deterministic."""
    pick = F.struct(*[F.col(c) for c in df.columns])
    by = F.struct(order, pick)
    return df.groupBy(key).agg(F.min_by(pick, by).alias("_r")).select("_r.*")


def _dedupe_last(df: DataFrame, key: str, order: Column) -> DataFrame:
    pick = F.struct(*[F.col(c) for c in df.columns])
    by = F.struct(order, pick)
    return df.groupBy(key).agg(F.max_by(pick, by).alias("_r")).select("_r.*")


# K1 / K4 ---------------------------------------------------------------------
def insert_if_absent(current: DataFrame, changes: DataFrame, order: Column, key: str = "id") -> DataFrame:
    """K1 (K4 with ``order`` = source rank): insert new keys, leave existing rows alone.

    Within one batch the first row per key wins (smallest ``order``, such as a time or a struct of time and sequence).
    """
    new = _dedupe_first(changes.select(*current.columns, order.alias("_o")), key, F.col("_o"))
    new = new.select(*current.columns).join(current.select(key), key, "left_anti")
    return current.unionByName(new)


# K2 / K3 ---------------------------------------------------------------------
def upsert_mail_labels(current: DataFrame, changes: DataFrame, order: Column, key: str = "id") -> DataFrame:
    """K2: insert new ids; for known ids replace only ``labels``. Adds ``outcome``
    (inserted / updated / unchanged) for K3. The last change per id wins (largest ``order``).

    Plan: the current table goes through a left join with the deduplicated
    changes (id, labels). Changes are normally far smaller than the mailbox,
    so AQE can broadcast them and the big table is not shuffled. A full outer
    join would always shuffle it, since Spark cannot broadcast either side of
    one. New ids come from an anti join against the current ids only.
    """
    ch = _dedupe_last(changes.select(*current.columns, order.alias("_o")), key, F.col("_o")).select(*current.columns)
    new_labels = ch.select(F.col(key).alias("_k"), F.col("labels").alias("_nl"), F.lit(True).alias("_hit"))
    kept = current.join(new_labels, current[key] == new_labels["_k"], "left")
    hit = F.coalesce(F.col("_hit"), F.lit(False))
    kept = kept.select(*[F.when(hit, F.col("_nl")).otherwise(F.col("labels")).alias(c) if c == "labels"
                         else F.col(c) for c in current.columns],
                       F.when(hit, F.lit("updated")).otherwise(F.lit("unchanged")).alias("outcome"))
    inserted = (ch.join(current.select(F.col(key).alias("_ck")), ch[key] == F.col("_ck"), "left_anti")
                .select(*current.columns, F.lit("inserted").alias("outcome")))
    return kept.unionByName(inserted)


def upsert_outcome_counts(upserted: DataFrame) -> DataFrame:
    """K3: rows inserted vs. updated by a K2 run (unchanged rows are not counted)."""
    return (upserted.filter(F.col("outcome") != "unchanged")
            .groupBy("outcome").agg(F.count(F.lit(1)).alias("n")))


# K5 / K13 --------------------------------------------------------------------
PASSIVE_SOURCES = ["daily_observation"]


def upsert_feedback_latest(current: DataFrame, changes: DataFrame, protect_human: bool = True,
                           seq: Column | None = None) -> DataFrame:
    """K5: last label wins per ``email_id``: label, source and time replaced.

    Order: (created_at, batch, seq), the change batch after the current row,
    so a change wins a tie in time; a null time loses. With ``protect_human``
    (the documented rule) a passive observation does not overwrite a human label.

    Plan: the latest change per id (``max_by``, partial aggregation over the
    changes only), left-joined onto the current table (broadcast when the
    changes are small, so the table is not shuffled), plus an anti join on
    the ids for new rows.
    """
    cols = ["email_id", "user_label", "source", "created_at"]
    ch = changes.select(*cols, (seq if seq is not None else F.lit(0)).cast("bigint").alias("_seq"))
    if protect_human:
        human = current.filter(F.col("source").isin(*HUMAN_SOURCES)).select("email_id")
        passive = ch.filter(F.col("source").isin(*PASSIVE_SOURCES)).join(human, "email_id", "left_anti")
        ch = ch.filter(~F.col("source").isin(*PASSIVE_SOURCES)).unionByName(passive)
    best = (ch.groupBy("email_id")
            .agg(F.max_by(F.struct(*cols), F.struct("created_at", "_seq", F.struct(*cols))).alias("_r"))
            .select("_r.*"))
    b = best.select(F.col("email_id").alias("_k"), F.col("user_label").alias("_nl"),
                    F.col("source").alias("_ns"), F.col("created_at").alias("_nc"), F.lit(True).alias("_hit"))
    j = current.join(b, current["email_id"] == b["_k"], "left")
    cc, nc = F.col("created_at"), F.col("_nc")
    take = F.coalesce(F.col("_hit"), F.lit(False)) & (cc.isNull() | (nc.isNotNull() & (nc >= cc)))
    kept = j.select("email_id",
                    F.when(take, F.col("_nl")).otherwise(F.col("user_label")).alias("user_label"),
                    F.when(take, F.col("_ns")).otherwise(F.col("source")).alias("source"),
                    F.when(take, nc).otherwise(cc).alias("created_at"))
    new = best.join(current.select(F.col("email_id").alias("_ck")), best["email_id"] == F.col("_ck"), "left_anti")
    return kept.unionByName(new.select(*cols))


def confirm_feedback(current: DataFrame, ids: DataFrame, as_of: _dt.datetime = AS_OF) -> DataFrame:
    """A human confirms automatic trash decisions: feedback spam / user_confirm / as_of."""
    ch = ids.select("email_id").distinct().select(
        "email_id", F.lit("spam").alias("user_label"), F.lit("user_confirm").alias("source"),
        S.as_of_ntz(as_of).alias("created_at"))
    return upsert_feedback_latest(current, ch, protect_human=False)


# K6 / K14 --------------------------------------------------------------------
def restore_feedback(current: DataFrame, ids: DataFrame, as_of: _dt.datetime = AS_OF) -> DataFrame:
    """K6: for the given ids that have feedback: keep / user_restore / as_of. Unknown ids are ignored.

    Adds ``restored`` (true where the row changed) so the caller can report
    both the number asked for and the number changed (Q13).
    """
    r = ids.select("email_id").distinct().withColumn("_hit", F.lit(True))
    j = current.join(r, "email_id", "left")
    hit = F.coalesce(F.col("_hit"), F.lit(False))
    return j.select(
        "email_id",
        F.when(hit, F.lit("keep")).otherwise(F.col("user_label")).alias("user_label"),
        F.when(hit, F.lit("user_restore")).otherwise(F.col("source")).alias("source"),
        F.when(hit, S.as_of_ntz(as_of)).otherwise(F.col("created_at")).alias("created_at"),
        hit.alias("restored"))


def apply_label_changes(labels: Column, add: list[str], remove: list[str]) -> Column:
    """K9: ``labels`` minus ``remove`` plus ``add`` (label sets, no duplicates)."""
    base = S.labels_or_empty(labels)
    rm = F.array(*[F.lit(x) for x in remove]) if remove else F.array().cast("array<string>")
    ad = F.array(*[F.lit(x) for x in add]) if add else F.array().cast("array<string>")
    return F.array_union(F.array_except(base, rm), ad)


LABEL_ACTIONS = {  # K9: action -> (add, remove)
    "trash": (["TRASH"], ["INBOX"]),
    "restore": (["INBOX"], ["TRASH"]),
}


def archive_labels(labels: Column, label: str) -> Column:
    return apply_label_changes(labels, [label], ["INBOX"])


def restore_full(emails: DataFrame, feedback: DataFrame, ids: DataFrame,
                 as_of: _dt.datetime = AS_OF) -> tuple[DataFrame, DataFrame, DataFrame]:
    """restore = feedback keep (K6) + mail back TRASH -> INBOX (K9) + an audit row.

    Returns (new feedback, changed mail rows, audit rows), all from one input.
    """
    fb = restore_feedback(feedback, ids, as_of)
    rid = ids.select(F.col("email_id").alias("id")).distinct()
    moved = emails.join(rid, "id", "inner").select(
        "id", apply_label_changes(F.col("labels"), *LABEL_ACTIONS["restore"]).alias("labels"))
    audit = audit_rows(rid.select(F.col("id").alias("email_id"), F.lit("restore").alias("action"),
                                  F.to_json(F.struct(F.lit("user_restore").alias("source"))).alias("metadata")),
                       as_of)
    return fb.drop("restored"), moved, audit


# K10 -------------------------------------------------------------------------
def action_outbox(ids: DataFrame, group_size: int = OUTBOX_GROUP_SIZE, partitions: int | None = None,
                  id_col: str = "id") -> DataFrame:
    """Change requests in groups of at most ``group_size`` ids; every id exactly once.

    Ids are hash-partitioned and sorted within each partition (deterministic
    on recompute), numbered inside their partition from
    ``monotonically_increasing_id`` (partition index in the upper bits, row
    index in the lower 33), and cut every ``group_size`` rows. No global
    window, no single-task step; the ``collect_list`` holds at most
    ``group_size`` ids.
    """
    d = ids.select(F.col(id_col).alias("id")).distinct()
    d = (d.repartition(partitions, "id") if partitions else d.repartition("id")).sortWithinPartitions("id")
    d = d.select("id", F.spark_partition_id().alias("_p"), F.monotonically_increasing_id().alias("_m"))
    row_in_part = F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))
    d = d.select("id", "_p", F.floor(row_in_part / group_size).alias("_g"))
    return (d.groupBy("_p", "_g").agg(F.sort_array(F.collect_list("id")).alias("ids"))
            .select(F.concat_ws("-", "_p", "_g").alias("batch_id"), F.size("ids").alias("n_ids"), "ids"))


# K11 / K12 -------------------------------------------------------------------
def decisions_from_triage(routed: DataFrame, pack: str = "web", as_of: _dt.datetime = AS_OF) -> DataFrame:
    """One decision row per (mail, model or rule version) from a triage result.

    Trashed routes -> spam; protected -> keep; ml_below -> keep; unmatched ->
    uncertain. Confidence: p(spam) for ml, 1 - p for ml_below, 1.0 for rule
    decisions, 0.0 when nothing decided.
    """
    r = F.col("route")
    decision = (F.when(r.isin("deletable", "grace_expired", "ml"), F.lit("spam"))
                .when(r.isin("protected", "ml_below"), F.lit("keep")).otherwise(F.lit("uncertain")))
    conf = (F.when(r == "ml", F.col("p_spam")).when(r == "ml_below", 1 - F.col("p_spam"))
            .when(r == "unmatched", F.lit(0.0)).otherwise(F.lit(1.0)))
    version = F.coalesce(F.col("model_version"), F.lit(f"rules:{pack}"))
    return routed.select(F.col("id").alias("email_id"), decision.alias("decision"),
                         F.round(conf, 6).alias("confidence"), version.alias("model_version"),
                         F.lit(False).alias("used_llm"), F.lit(None).cast("string").alias("llm_reasoning"),
                         S.as_of_ntz(as_of).alias("decided_at"),
                         (decision == "spam").alias("executed"))


def append_decisions(current: DataFrame, new: DataFrame) -> DataFrame:
    """Append, first row per (email_id, model_version) wins (the primary key)."""
    key = F.concat_ws("\u0001", "email_id", "model_version")
    cur = current.withColumn("_k", key)
    nw = new.select(*current.columns).withColumn("_k", key)
    add = _dedupe_first(nw, "_k", F.col("decided_at")).join(cur.select("_k"), "_k", "left_anti")
    return cur.unionByName(add).drop("_k")


def audit_rows(actions: DataFrame, as_of: _dt.datetime = AS_OF) -> DataFrame:
    """One audit row per automatic action; the id is a content hash, so a retry is idempotent."""
    ts = S.as_of_ntz(as_of)
    return actions.select(
        F.sha2(F.concat_ws("|", "email_id", "action", ts.cast("string")), 256).alias("id"),
        "email_id", "action", ts.alias("performed_at"), "metadata")


def audit_from_actions(actions: DataFrame, as_of: _dt.datetime = AS_OF) -> DataFrame:
    a = actions.select(F.col("id").alias("email_id"), F.lit("auto_trash").alias("action"),
                       F.to_json(F.struct("route", "rule_id")).alias("metadata"))
    return audit_rows(a, as_of)


# K8 --------------------------------------------------------------------------
def run_log_row(summary: DataFrame, as_of: _dt.datetime = AS_OF) -> DataFrame:
    """K8: one log line per run from the G1 summary."""
    return summary.select(
        S.as_of_ntz(as_of).alias("run_at"), F.lit("OK").alias("status"), "scanned",
        (F.col("deletable_rules") + F.col("deletable_ml") + F.col("grace_expired")).alias("trashed"),
        F.col("deletable_rules").alias("rules"), F.col("deletable_ml").alias("ml"),
        F.col("grace_expired").alias("grace"), F.col("protected_by_rule").alias("protected"),
        F.col("ml_below_threshold").alias("ml_below"), F.lit(None).cast("string").alias("error"))


RUN_LOG = ("run_at timestamp_ntz, status string, scanned bigint, trashed bigint, rules bigint, ml bigint, grace bigint, "
           "protected bigint, ml_below bigint, error string")


def run_log_error(spark: SparkSession, error: BaseException, as_of: _dt.datetime = AS_OF) -> DataFrame:
    """K8: the log line of a failed run (error type and text), in the form of ``run_log_row``."""
    row = (as_of, "ERROR", *[None] * 7, f"{type(error).__name__}: {error}")
    return spark.createDataFrame([row], RUN_LOG)


# V1-V5 -----------------------------------------------------------------------
def check_primary_key(df: DataFrame, keys: list[str]) -> DataFrame:
    """V1: key values that occur more than once (with their count)."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)


def check_not_null(df: DataFrame, cols: list[str]) -> DataFrame:
    """V2: rows violating NOT NULL, with the list of offending columns (quarantine)."""
    return df.withColumn("null_columns", null_columns(cols)).filter(F.size("null_columns") > 0)


def null_columns(cols) -> Column:
    """Names of the columns that are null in a row."""
    return F.filter(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in cols]), lambda x: x.isNotNull())


def check_enum(df: DataFrame, col: str, values: list[str]) -> DataFrame:
    """V3: rows whose ``col`` is outside the allowed values (null passes, as in SQL CHECK)."""
    return df.filter(~F.col(col).isin(*values))


def check_range(df: DataFrame, col: str, lo: float, hi: float) -> DataFrame:
    """V4: rows with ``col`` outside [lo, hi]."""
    return df.filter(~F.col(col).between(lo, hi))


def apply_defaults(df: DataFrame, defaults: dict[str, Column]) -> DataFrame:
    """V5: fill missing values with their column defaults."""
    return df.withColumns({c: F.coalesce(F.col(c), v) for c, v in defaults.items()})


ENUMS = {"decision": DECISION_VALUES, "final_state": FINAL_STATES, "user_label": USER_LABELS}


# J6 / J7 / W6 ----------------------------------------------------------------
def fk_orphans(child: DataFrame, parent: DataFrame, child_key: str = "email_id",
               parent_key: str = "id") -> DataFrame:
    """Child rows whose parent row is missing."""
    return child.join(parent.select(F.col(parent_key).alias(child_key)), child_key, "left_anti")


def cascade_delete(child: DataFrame, deleted_ids: DataFrame, child_key: str = "email_id") -> DataFrame:
    """Child rows that survive the deletion of ``deleted_ids``."""
    return child.join(deleted_ids.select(F.col(deleted_ids.columns[0]).alias(child_key)).distinct(),
                      child_key, "left_anti")


def latest_per_key(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Last row per key by ``order`` (``max_by``: partial aggregation, no sort)."""
    cols = [c for c in df.columns]
    return (df.groupBy(key).agg(F.max_by(F.struct(*cols), F.struct(*order)).alias("_r")).select("_r.*"))
