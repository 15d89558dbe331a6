"""Regex dialects.

Rules are written in the Python ``re`` dialect with ``re.I``. On the JVM the
flags ``(?iUd)`` reproduce it: case-insensitive with Unicode case folding,
Unicode ``\\w``/``\\b``/``\\s``, and ``.``/``$`` that know only ``\\n`` as a line
end. ``rlike`` searches (``Matcher.find``), like ``re.search``.

DuckDB (RE2) is used only by the oracle SQL. There ``\\b`` and ``\\s`` are
ASCII, so ``oracle_regex`` rewrites them into explicit Unicode classes.
"""
from __future__ import annotations

SPARK_FLAGS = "(?iUd)"

_WORD = r"\p{L}\p{N}_"
_SPACE = r"[\t\n\x{0B}\f\r\x{85}\p{Z}]"


def spark_regex(pattern: str) -> str:
    return SPARK_FLAGS + pattern


def spark_alternation(patterns: list[str]) -> str:
    """One pattern that matches iff any of ``patterns`` does."""
    return SPARK_FLAGS + "(?:" + "|".join(f"(?:{p})" for p in patterns) + ")"


def oracle_regex(pattern: str) -> str:
    """RE2 form of a rule pattern, for DuckDB ``regexp_matches``."""
    p = pattern
    # "\b X \b.*\b Y": one non-word char may serve both boundaries.
    p = p.replace(r"\b.*\b", f"[^{_WORD}](?:.*[^{_WORD}])?")
    out = []
    i = 0
    while i < len(p):
        if p.startswith(r"\b", i):
            nxt = p[i + 2] if i + 2 < len(p) else ""
            if nxt and (nxt.isalnum() or nxt in "(["):
                out.append(f"(?:^|[^{_WORD}])")
            else:
                out.append(f"(?:$|[^{_WORD}])")
            i += 2
        elif p.startswith(r"\s", i):
            out.append(_SPACE)
            i += 2
        elif p[i] == "\\" and i + 1 < len(p):
            out.append(p[i:i + 2])
            i += 2
        else:
            out.append(p[i])
            i += 1
    return "(?i)" + "".join(out)


def sql_str(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"
