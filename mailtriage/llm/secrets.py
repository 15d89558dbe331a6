"""Incremental secret scan over content-addressed blobs.

Every historical version (path, text) is addressed by the SHA-256 of its text. A ledger table remembers which
(blob, rule version) pairs have been scanned, with their findings. A run scans each unseen blob once, appends to
the ledger, and joins the findings back to every path that holds the blob. DataFrame functions only.

A rule's matches are leftmost and non-overlapping: the texts between matches and the matches themselves are
taken from one regular expression, and their lengths add up to the places (code points, end exclusive).
"""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from mailtriage.session import cut

from .text import read


@dataclass(frozen=True)
class Rule:
    """``pattern`` finds; a match stays if its group ``group`` has at least ``least`` characters."""
    kind: str
    pattern: str
    group: int = 0
    least: int = 1


#: The three base kinds, in their order.
BASE = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]+", 0, 24),
)
#: Added kinds: key blocks and tokens of well-known public formats.
ADDED = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 30),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 0, 20),
)
RULES = BASE + ADDED


def version_of(rules: tuple[Rule, ...]) -> str:
    """The rules' version: a digest of all they consist of, so that changed rules never find old entries."""
    import hashlib
    return hashlib.sha256(repr((rules, sorted(HINTS.items()))).encode()).hexdigest()[:16]



#: Tests that a text can hold a finding at all, so that the others are not cut up.
HINTS = {"hex": r"[0-9a-f]{24}", "access": "AKIA[A-Z0-9]{16}"}

SPAN = "array<struct<start:int,kind_no:int,kind:string,stop:int>>"


def spans(text: Column, rule: Rule, number: int) -> Column:
    """Sorted spans of one rule: array of (start, kind_no, kind, stop)."""
    found = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    judged = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group))
    between = F.split(text, rule.pattern, -1)
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))

    def step(acc: Column, m: Column) -> Column:
        begin = acc["at"] + F.length(m["gap"])
        stop = begin + F.length(m["whole"])
        one = F.struct(begin.alias("start"), F.lit(number).alias("kind_no"), F.lit(rule.kind).alias("kind"), stop.alias("stop"))
        return F.struct(stop.alias("at"), F.when(F.length(m["part"]) >= rule.least, F.concat(acc["out"], F.array(one)))
                        .otherwise(acc["out"]).alias("out"))

    rows = F.arrays_zip(F.slice(between, F.lit(1), F.size(found)).alias("gap"), found.alias("whole"), judged.alias("part"))
    all_spans = F.aggregate(rows, start, step)["out"]
    return F.when(text.rlike(HINTS.get(rule.kind, rule.pattern)), all_spans).otherwise(F.array().cast(SPAN))


def scan(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``blobs(blob, text)`` -> ``(blob, found)``: all spans of a blob by start, then kind."""
    parts = [spans(F.col("text"), r, i) for i, r in enumerate(rules)]
    return blobs.select("blob", F.sort_array(F.concat(*parts)).alias("found"))


def blob_id(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def scan_versions(versions: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES,
                  rule_version: str | None = None, path: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """``(findings, ledger)``: findings ``(path, blob, found)`` for every row of ``versions``, and the new ledger
    ``(blob, rule_version, found)``, both over written tables.

    Only pairs of blob and rule version that the old ledger lacks are scanned, one time each, whatever number of paths
    holds the blob. The version is a digest of the rules, unless one is given. A null text is the empty blob. Repeated rows and null paths are answered row by row. An empty table
    gives empty tables; other columns are not read. Findings are joined on the blob; a blob with very many paths is
    one row on its side, and AQE splits the other.
    """
    rule_version = rule_version or version_of(rules)
    rows = versions.select(F.col(path).alias("path"), blob_id(F.col(text)).alias("blob"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    unseen = rows
    if ledger is not None:
        unseen = rows.join(ledger.where(F.col("rule_version") == rule_version).select("blob"), "blob", "left_anti")
    # one text for each unseen blob: map tasks keep one copy each, a third of all rows may be one blob
    fresh = unseen.groupBy("blob").agg(F.first("text").alias("text"))
    scanned = cut(scan(fresh, rules).select("blob", F.lit(rule_version).alias("rule_version"), "found"), "ledger")
    full = scanned if ledger is None else ledger.unionByName(scanned)
    current = full.where(F.col("rule_version") == rule_version).select("blob", "found")
    findings = rows.select("path", "blob").join(current, "blob").select(F.col("path").alias(path), "blob", "found")
    return findings, full


def joined(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: spans of all documents, scanned blob by blob against an empty ledger."""
    findings, _ = scan_versions(read(spark, sf_dir, "documents"))
    f = F.col("found")
    count = lambda kind: F.size(F.filter(f, lambda s: s["kind"] == kind)).cast("bigint")
    base = F.filter(f, lambda s: s["kind_no"] < len(BASE))
    return findings.select("doc_id", *[count(r.kind).alias(f"n_{r.kind}") for r in BASE],
                           F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(f).alias("spans"))


def _oracle() -> str:
    parts = []
    for i, r in enumerate(RULES):
        p = r.pattern.replace("'", "''")
        parts.append(f"""select doc_id, {i} as k, '{r.kind}' as kind, {r.least} as least, regexp_extract_all(t, '{p}') as found,
   regexp_extract_all(t, '{p}', {r.group}) as part, string_split_regex(t, '{p}') as gap from d""")
    union = "\nunion all ".join(parts)
    return f"""
with d as (select doc_id, coalesce(text, '') as t from documents),
m as ({union}),
s as (select doc_id, k, kind, least, part[i] as part, found[i] as whole,
        list_sum(list_transform(gap[1:i], lambda x: length(x)))::bigint + coalesce(list_sum(list_transform(found[1:i - 1], lambda x: length(x))), 0)::bigint as b
      from (select *, unnest(generate_series(1, len(found))) as i from m where len(found) > 0)),
f as (select doc_id, k, kind, b, b + length(whole) as e from s where length(part) >= least),
a as (select doc_id, count(*) filter (kind = 'assign') as n_assign, count(*) filter (kind = 'access') as n_access, count(*) filter (kind = 'hex') as n_hex,
        string_agg(kind || ':' || b || ':' || e, ',' order by b, k) filter (k < {len(BASE)}) as base,
        string_agg(kind || ':' || b || ':' || e, ',' order by b, k) as spans from f group by doc_id)
select d.doc_id, coalesce(n_assign, 0)::bigint as n_assign, coalesce(n_access, 0)::bigint as n_access, coalesce(n_hex, 0)::bigint as n_hex,
  sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from d left join a on d.doc_id = a.doc_id
"""


ORACLE = _oracle()
