"""T3 as a commit protocol: plan, dry run, journal, atomic switch, quarantine (Q10), run log (K8).

A ``Store`` is a folder of tables. Every table version is a folder of its own that is never changed; the *manifest* of
the newest number says which folder is each table's current version. A run writes new folders, notes each finished one
in its journal, and switches all tables at once by writing the next manifest. So readers see all of a run or nothing,
a run that dies between two tables leaves no effect, and the same run started again takes the finished steps from
its journal (the plan too, so it decides alike) and does the others. A committed run started again does nothing.
Two runs that start from one manifest can't both switch: the second one's number is taken, and it fails.

Order of the steps (Q16): what was decided and why comes first, mail rows before the feedback that refers to them,
requests to the provider last.
"""
from __future__ import annotations

import datetime as _dt
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.packs import DEFAULT_PACK, ML_SPAM_THRESHOLD, TRIAGE_WINDOW_DAYS
from ..session import AS_OF
from . import tables as K

SCHEMAS = {
    "decisions": "email_id string, decision string, confidence double, model_version string, used_llm boolean, llm_reasoning string, decided_at timestamp_ntz, executed boolean",
    "audit_log": "id string, email_id string, action string, performed_at timestamp_ntz, metadata string",
    "raw_emails": "id string, thread_id string, sender string, sender_domain string, subject string, snippet string, labels array<string>, received_at timestamp_ntz",
    "feedback": "email_id string, user_label string, source string, created_at timestamp_ntz",
}
#: Columns of ``raw_emails`` that may not be null (the id is its key).
NOT_NULL = ("id", "thread_id", "sender", "sender_domain", "received_at")
MANIFEST = "version bigint, run_id string, name string, path string"


def split_not_null(df: DataFrame, cols, folder: str) -> tuple[DataFrame, DataFrame]:
    """V2 as a two-way split: (rows without a null in ``cols``, the others with ``null_columns``).

    ``df`` is evaluated and written once, in two folders; each side reads its own. A column named ``null_columns`` or
    ``_ok`` raises ValueError. No rows give two empty tables.
    """
    if clash := {"null_columns", "_ok"} & {c.lower() for c in df.columns}:
        raise ValueError(f"columns {sorted(clash)} are the split's own: rename them first")
    marked = df.withColumn("null_columns", K.null_columns(cols))
    marked = marked.withColumn("_ok", F.size("null_columns") == 0)
    marked.write.mode("overwrite").partitionBy("_ok").parquet(folder)
    try:
        back = df.sparkSession.read.schema(marked.schema).parquet(folder)
        back.head(0)
    except AnalysisException:
        back = df.sparkSession.createDataFrame([], marked.schema)
    return back.where("_ok").drop("_ok", "null_columns"), back.where("not _ok").drop("_ok")


class Store:
    """Versioned tables below ``root`` (a shared folder), switched together by a manifest."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _read(self, path: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(path)
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], schema)

    def manifest(self) -> tuple[int, dict[str, str], set[str]]:
        """(number, current folder of each table, runs that are committed): one row per table and run."""
        rows = self._read(f"{self.root}/manifest", MANIFEST).collect()
        newest = max((r["version"] for r in rows), default=0)
        return newest, {r["name"]: r["path"] for r in rows if r["version"] == newest and r["name"]}, {r["run_id"] for r in rows}

    def current(self, name: str, paths: dict[str, str] | None = None) -> DataFrame:
        """The table's current version, or an empty table before the first."""
        paths = self.manifest()[1] if paths is None else paths
        if name in paths:
            return self.spark.read.parquet(paths[name])
        return self.spark.createDataFrame([], SCHEMAS[name])

    def write(self, name: str, df: DataFrame) -> str:
        """A new folder with ``df``; nobody reads it till a manifest names it."""
        path = f"{self.root}/tables/{name}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        return path

    def switch(self, before: int, paths: dict[str, str], run_id: str) -> None:
        """Make ``paths`` current, if ``before`` is still the newest manifest."""
        rows = [(before + 1, run_id, n, p) for n, p in sorted(paths.items())]
        self.spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("errorifexists").parquet(
            f"{self.root}/manifest/number={before + 1:08d}")

    def journal(self, run_id: str) -> dict[str, str]:
        """Finished steps of a run and their folders."""
        rows = self._read(f"{self.root}/journal/{run_id}", "step string, path string, at bigint").collect()
        return {r["step"]: r["path"] for r in sorted(rows, key=lambda r: r["at"])}

    def entries(self, run_id: str) -> int:
        return self._read(f"{self.root}/journal/{run_id}", "step string").count()

    def note(self, run_id: str, step: str, path: str, at: int) -> None:
        self.spark.createDataFrame([(step, path, at)], "step string, path string, at bigint").coalesce(1).write.mode(
            "append").parquet(f"{self.root}/journal/{run_id}")

    def log(self, run_id: str, line: DataFrame, name: str) -> None:
        """One line of the run log; the same line of the same run replaces itself."""
        line.coalesce(1).write.mode("overwrite").parquet(f"{self.root}/run_log/{run_id}-{name}")

    def run_log(self) -> DataFrame:
        return self._read(f"{self.root}/run_log/*", K.RUN_LOG)


def scanned_counts(listed: DataFrame, emails: DataFrame, id_col: str = "id") -> DataFrame:
    """Q17: ids that the scan listed, and those still there when they were fetched."""
    ids = listed.select(F.col(id_col).alias("id")).where("id is not null").distinct()
    hit = emails.select("id").distinct().withColumn("_there", F.lit(True))
    return ids.join(hit, "id", "left").agg(F.count(F.lit(1)).alias("listed"), F.count("_there").alias("fetched"))


def triage_plan(routed: DataFrame) -> DataFrame:
    """What a run would trash, with route, rule, action and the mail's own columns."""
    from ..plans import triage as T
    mail = routed.select("id", "sender", "sender_domain", "subject", "received_at", "age_days")
    return T.actions(routed).join(mail, "id")


def triage_commit(store: Store, emails: DataFrame, run_id: str, as_of: _dt.datetime = AS_OF, pack: str = DEFAULT_PACK,
                  scorer=None, days_window: int | None = TRIAGE_WINDOW_DAYS, threshold: float = ML_SPAM_THRESHOLD,
                  dry_run: bool = False, on_step: Callable[[str], None] | None = None) -> DataFrame:
    """T3. Dry run: the plan (``triage_plan``), and the store stays as it is. Live run: (table, rows) after the commit.

    Mail with a null in a NOT NULL column is quarantined before anything is decided on it (Q10). Mail that is acted on
    is inserted if absent, gets feedback ``auto_clean:..``, a label change and a request in
    the outbox; all scanned mail gets a decision row, acted mail an audit row. An error is logged as a line of the run
    log and raised; the same ``run_id`` then resumes. ``on_step`` is called before each step with its name.
    """
    from ..plans import triage as T
    if "null_columns" in {c.lower() for c in emails.columns}:
        raise ValueError("the column null_columns is the quarantine's own: rename it first")
    done = store.journal(run_id)
    number, paths, runs = store.manifest()
    state = {"at": store.entries(run_id)}

    def step(name: str, make: Callable[[], DataFrame]) -> DataFrame:
        if name not in done:
            if on_step:
                on_step(name)
            done[name] = store.write(name, make())
            state["at"] += 1
            store.note(run_id, name, done[name], state["at"])
        return store.spark.read.parquet(done[name])

    def plan_of(mail: DataFrame) -> DataFrame:
        return T.triage(mail, as_of, pack, scorer, days_window, threshold)

    if dry_run:
        return triage_plan(plan_of(emails.where(F.size(K.null_columns(NOT_NULL)) == 0)))
    try:
        if run_id not in runs:
            if done.get("base") != str(number):  # tables made from an older manifest would undo another run's work
                for name in set(done) - {"scanned", "quarantine", "plan"}:
                    del done[name]
                done["base"] = str(number)
                state["at"] += 1
                store.note(run_id, "base", str(number), state["at"])
            scanned = step("scanned", lambda: emails.withColumn("null_columns", K.null_columns(NOT_NULL)))
            whole = F.size("null_columns") == 0
            step("quarantine", lambda: scanned.where(~whole))
            r = step("plan", lambda: plan_of(scanned.where(whole).drop("null_columns")))
            acts = T.actions(r)
            acted = r.join(acts.select("id"), "id", "left_semi")
            now = lambda name: store.current(name, paths)
            cols = now("raw_emails").columns
            step("decisions", lambda: K.append_decisions(now("decisions"), K.decisions_from_triage(r, pack, as_of)))
            step("audit_log", lambda: _append_new(now("audit_log"), K.audit_from_actions(acts, as_of)))
            step("raw_emails", lambda: K.insert_if_absent(now("raw_emails"), acted.select(*cols), F.col("received_at")))
            step("feedback", lambda: K.upsert_feedback_latest(now("feedback"), T.commit_feedback(r, acts, as_of)))
            step("label_changes", lambda: acted.select("id", K.apply_label_changes(F.col("labels"), *K.LABEL_ACTIONS["trash"]).alias("labels")))
            step("outbox", lambda: K.action_outbox(acts.select("id")))
            if on_step:
                on_step("switch")
            own = {n: p for n, p in done.items() if n not in ("base", "scanned", "plan")}
            store.switch(number, {**paths, **own}, run_id)
        if on_step:
            on_step("run_log")
        store.log(run_id, K.run_log_row(T.triage_summary(store.spark.read.parquet(done["plan"])), as_of), "ok")
    except Exception as e:
        store.log(run_id, K.run_log_error(store.spark, e, as_of), f"error-{uuid.uuid4().hex}")
        raise
    return report(store, run_id)


def report(store: Store, run_id: str) -> DataFrame:
    """(table, rows) of what a committed run wrote."""
    out = None
    for name, path in sorted(store.journal(run_id).items()):
        if name not in ("base", "scanned"):
            one = store.spark.read.parquet(path).agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table"), "rows")
            out = one if out is None else out.unionByName(one)
    return out


def _append_new(current: DataFrame, new: DataFrame) -> DataFrame:
    """Rows with a new id (audit ids are content hashes) below the current ones."""
    return current.unionByName(new.select(*current.columns).join(current.select("id"), "id", "left_anti"))
