"""DuckDB SQL fragments for the oracle side (rules and scalars).

These restate in SQL what the Spark operators compute, from the same fixed
rule packs, with patterns in the RE2 form of ``functions.regex.oracle_regex``.
"""
from __future__ import annotations

from ..functions.packs import (DEFAULT_PACK, KEYWORD_PATTERNS, LAYER_DECISION, LAYERS,
                               PACKS, READ_LATER_PATTERN, REASON_PREFIX)
from ..functions.regex import oracle_regex, sql_str
from ..sources.fixtures import oracle_with

AS_OF = "TIMESTAMP '2024-02-01 00:00:00'"
WS = r"[\t\n\x{0B}\f\r\x{85}\p{Z}]"


def rx(col: str, pattern: str) -> str:
    return f"regexp_matches({col}, {sql_str(oracle_regex(pattern))})"


def strip(col: str) -> str:
    return f"regexp_replace({col}, {sql_str('^' + WS + '+|' + WS + '+$')}, '', 'g')"


def norm_sender(col: str = "sender") -> str:
    return strip(f"coalesce({col}, '')")


def norm_domain(col: str = "sender_domain") -> str:
    return f"lower({strip(f'coalesce({col}, {chr(39)}{chr(39)})')})"


def norm_subject(col: str = "subject") -> str:
    return f"coalesce({col}, '')"


def _conditions(pack: str, layer: str, s: str, d: str, t: str):
    out = []
    for rule in PACKS[pack][layer]:
        if layer == "combo":
            sp, tp, rid = rule
            out.append((f"({rx(s, sp)} AND {rx(t, tp)})", rid))
        elif layer == "keep_domain":
            p, rid = rule
            out.append((f"({rx(d, p)} OR {rx(s, p)})", rid))
        elif layer == "keep_subject":
            p, rid = rule
            out.append((rx(t, p), rid))
        else:
            p, rid = rule
            out.append((rx(d, p), rid))
    return out


def first_hit_case(value: str, pack: str = DEFAULT_PACK, s: str = "s", d: str = "d", t: str = "t",
                   layers=LAYERS) -> str:
    """CASE chain giving, for the first rule that fires, ``rule_id`` / ``decision`` / ``reason``."""
    layers = tuple(layers)
    whens = []
    for layer in layers:
        for cond, rid in _conditions(pack, layer, s, d, t):
            v = {"rule_id": sql_str(rid), "decision": sql_str(LAYER_DECISION[layer]),
                 "reason": sql_str(REASON_PREFIX[layer] + rid)}[value]
            whens.append(f"WHEN {cond} THEN {v}")
    return "CASE " + " ".join(whens) + " END"


def all_hits_values(pack: str = DEFAULT_PACK, s: str = "s", d: str = "d", t: str = "t") -> str:
    """UNION ALL of one SELECT per rule: (layer, layer_no, ord, decision, rule_id, cond)."""
    parts = []
    for layer_no, layer in enumerate(LAYERS, start=1):
        for ord_, (cond, rid) in enumerate(_conditions(pack, layer, s, d, t), start=1):
            parts.append(f"SELECT id, {sql_str(layer)} AS layer, {layer_no} AS layer_no, {ord_} AS ord, "
                         f"{sql_str(LAYER_DECISION[layer])} AS decision, {sql_str(rid)} AS rule_id "
                         f"FROM n WHERE {cond}")
    return "\nUNION ALL ".join(parts)


def read_later_sql(s: str, d: str) -> str:
    return f"({rx(d, READ_LATER_PATTERN)} OR {rx(s, READ_LATER_PATTERN)})"


def keyword_flags_sql(t: str = "t") -> str:
    return ", ".join(f"CAST({rx(t, p)} AS INTEGER) AS {name}" for name, p in KEYWORD_PATTERNS)


def age_days(col: str = "received_at", as_of: str = AS_OF) -> str:
    return f"CAST(floor((epoch_us({as_of}) - epoch_us({col})) / 86400000000.0) AS BIGINT)"


def has(label: str, col: str = "labels") -> str:
    return f"list_contains(coalesce({col}, []::VARCHAR[]), {sql_str(label)})"


def newer_than(days: int, col: str = "received_at") -> str:
    return f"{col} >= {AS_OF} - INTERVAL {days} DAY"


def routed_sql(pack: str = DEFAULT_PACK, window_days: int | None = 30) -> str:
    """Rules-only triage (T2) as SQL: one row per scanned mail with its route."""
    where = f"WHERE {has('INBOX')} AND {newer_than(window_days)}" if window_days is not None else ""
    return f"""
n AS (SELECT id, thread_id, sender, sender_domain, subject, snippet, labels, received_at,
        {norm_sender()} AS s, {norm_domain()} AS d, {norm_subject()} AS t,
        {has('UNREAD')} AS is_unread, {age_days()} AS age_days
      FROM raw_emails {where}),
h AS (SELECT *, {first_hit_case('rule_id', pack)} AS rule_id, {first_hit_case('decision', pack)} AS decision,
        {first_hit_case('reason', pack)} AS reason FROM n),
routed AS (SELECT *, CASE WHEN rule_id IS NULL THEN 'unmatched' WHEN decision = 'deletable' THEN 'deletable'
        WHEN received_at IS NULL OR age_days < 7 OR NOT is_unread THEN 'protected' ELSE 'grace_expired' END AS route
      FROM h)"""


def with_routed(pack: str = DEFAULT_PACK, window_days: int | None = 30, views=("raw_emails",)) -> str:
    return oracle_with(*views).rstrip() + ",\n" + routed_sql(pack, window_days).strip() + "\n"
