"""Rule matching (R1-R7, R14, R16) compiled to Spark SQL expressions.

A pack (``functions.packs``) is a small, fixed list of patterns, so it is
compiled into the query plan as literals: ``rlike`` on a literal pattern
compiles once per task. No rule data is shuffled or broadcast. The expression
is generated as SQL text and parsed once (``F.expr``), which is much cheaper
than assembling hundreds of Column objects over the Python-JVM bridge.

Evaluation is chunked (``CHUNK`` rules per chunk). Each chunk is first tested
with one alternation of its patterns; the rule is resolved only when that
guard hits. Alternation matches iff some part matches, so the result is the
same, but a row that no rule touches (the common case) costs one regex per
chunk instead of one per rule, and a row stops paying once a rule has hit.

For rule tables too large to compile (thousands of rules) ``first_hit_index``
finds each mail's candidate rules by an equi join on four-character pieces that
the patterns require, and runs the regex on candidates only; ``first_hit_table``
evaluates all rules as a broadcast nested-loop join.
"""
from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.packs import DEFAULT_PACK, LAYERS, PACKS, READ_LATER_PATTERN, pack_rows
from ..functions.regex import spark_alternation, spark_regex
from ..functions.scalars import normalize_inputs, sender_address
from ..session import cut

CHUNK = 8
RULE_TABLE_BROADCAST_MAX = 100_000   # rows; beyond this, split the rule table and union


def _q(s: str) -> str:
    """Spark SQL string literal (raw for regex patterns: no escape processing)."""
    if "'" not in s:
        return "r'" + s + "'"
    return '"' + s.replace("\\", "\\\\").replace('"', '\\"') + '"'


def _rl(col: str, pattern: str) -> str:
    return f"({col} RLIKE {_q(spark_regex(pattern))})"


def _rl_alt(col: str, patterns: list[str]) -> str:
    return f"({col} RLIKE {_q(spark_alternation(patterns))})"


def _rule_numbers(pack: str) -> dict[tuple[str, str], int]:
    """(layer, rule_id) -> 1-based position of the rule in evaluation order."""
    return {(r["layer"], r["rule_id"]): i for i, r in enumerate(pack_rows(pack), start=1)}


def _conditions(layer: str, rules, s: str, d: str, t: str) -> list[tuple[str, str]]:
    """[(SQL condition, rule_id)] of one layer, in order."""
    out = []
    for rule in rules:
        if layer == "combo":                      # R1: sender AND subject
            sp, tp, rid = rule
            out.append((f"({_rl(s, sp)} AND {_rl(t, tp)})", rid))
        elif layer == "keep_domain":              # R2: domain OR full sender
            p, rid = rule
            out.append((f"({_rl(d, p)} OR {_rl(s, p)})", rid))
        elif layer == "keep_subject":             # R3
            p, rid = rule
            out.append((_rl(t, p), rid))
        else:                                     # R4: domain only
            p, rid = rule
            out.append((_rl(d, p), rid))
    return out


def _guard(layer: str, rules, s: str, d: str, t: str) -> str:
    """One alternation over ``rules``: true iff some rule of the list can fire."""
    if layer == "combo":
        return f"({_rl_alt(s, [r[0] for r in rules])} AND {_rl_alt(t, [r[1] for r in rules])})"
    pats = [r[0] for r in rules]
    if layer == "keep_domain":
        return f"({_rl_alt(d, pats)} OR {_rl_alt(s, pats)})"
    if layer == "keep_subject":
        return _rl_alt(t, pats)
    return _rl_alt(d, pats)


@functools.lru_cache(maxsize=64)
def first_hit_sql(s: str, d: str, t: str, pack: str = DEFAULT_PACK,
                  layers: tuple[str, ...] = LAYERS) -> str:
    """SQL for the number of the first rule that fires (null = none).

    Each chunk is ``CASE WHEN prev IS NULL AND guard THEN <chain> ELSE prev END``
    applied through a one-element ``transform``: higher-order functions are
    evaluated outside whole-stage codegen, so a pack of any size never yields a
    generated method beyond the JVM's 64 KB limit (a failed compile costs
    seconds per query before Spark falls back). ``s``, ``d``, ``t`` name
    columns holding the (normalised) sender, domain and subject.
    """
    nums = _rule_numbers(pack)
    expr = "CAST(NULL AS INT)"
    for layer in layers:
        rules = PACKS[pack][layer]
        conds = _conditions(layer, rules, s, d, t)
        for i in range(0, len(rules), CHUNK):
            chain = " ".join(f"WHEN {c} THEN {nums[(layer, rid)]}" for c, rid in conds[i:i + CHUNK])
            guard = _guard(layer, rules[i:i + CHUNK], s, d, t)
            expr = (f"transform(array({expr}), _prev -> CASE WHEN _prev IS NULL AND {guard} "
                    f"THEN CASE {chain} END ELSE _prev END)[0]")
    return expr


@functools.lru_cache(maxsize=16)
def _hit_table_sql(pack: str) -> str:
    items = ", ".join(f"named_struct('decision', {_q(r['decision'])}, 'rule_id', {_q(r['rule_id'])}, "
                      f"'reason', {_q(r['reason'])})" for r in pack_rows(pack))
    return f"array({items})"


def hit_of(rule_no: Column, pack: str = DEFAULT_PACK) -> Column:
    """``struct<decision, rule_id, reason>`` of a rule number (null stays null).

    The pack is one constant array of structs; the lookup is a single ``get``.
    """
    return F.get(F.expr(_hit_table_sql(pack)), rule_no - 1)


def apply_rules(df: DataFrame, pack: str = DEFAULT_PACK, sender: str = "sender",
                domain: str = "sender_domain", subject: str = "subject", out: str = "hit",
                normalize: bool = True, layers: tuple[str, ...] = LAYERS, match_on: str = "text") -> DataFrame:
    """R5 on a DataFrame: adds ``out`` = first hit struct (null = no hit).

    ``match_on``: sender rules see the whole From text (``text``, the default: a rule that ends in ``$`` doesn't match
    ``Name <a@b>``) or only its address (``address``, Q2).

    First rule in order combo > keep domain > keep subject > deletable, list
    order within. Two projections: the normalised inputs (P6: strip sender,
    strip+lower domain, null -> ''), computed once per row and read by every
    rule, then the chunked rule evaluation.

    The rule number is produced by a one-row ``explode``: Catalyst never pushes
    a predicate on a generator's output below the generator, so a later filter
    on the hit (or on a route derived from it) cannot copy the rule expression
    into the scan filter; the rules run exactly once per row. Filters on other
    columns still reach the scan.
    """
    if normalize:
        s, d, t = normalize_inputs(F.col(sender), F.col(domain), F.col(subject))
    else:
        s, d, t = (F.coalesce(F.col(c), F.lit("")) for c in (sender, domain, subject))
    if match_on not in ("text", "address"):
        raise ValueError(f"match_on is text or address, not {match_on}")
    if match_on == "address":
        s = sender_address(s)
    cur = df.withColumns({"_rs": s, "_rd": d, "_rt": t})
    no = F.expr(first_hit_sql("_rs", "_rd", "_rt", pack, tuple(layers)))
    cur = cur.select("*", F.explode(F.array(no)).alias("_rno"))
    return cur.withColumn(out, hit_of(F.col("_rno"), pack)).drop("_rs", "_rd", "_rt", "_rno")


def transactional_rules(df: DataFrame, pack: str = DEFAULT_PACK, out: str = "tx_rule",
                        sender: str = "sender", domain: str = "sender_domain",
                        subject: str = "subject") -> DataFrame:
    """Rule id of the first keep rule (combo, domain, subject); inputs not normalised, null -> ''."""
    return (apply_rules(df, pack, sender, domain, subject, out="_txhit", normalize=False,
                        layers=("combo", "keep_domain", "keep_subject"))
            .withColumn(out, F.col("_txhit.rule_id")).drop("_txhit"))


@functools.lru_cache(maxsize=16)
def all_hits_sql(s: str, d: str, t: str, pack: str = DEFAULT_PACK) -> str:
    """Every rule that fires, in order. Each chunk of ``CHUNK`` rules is tested only when
    its alternation guard matches, so a row no rule touches costs one regex per chunk."""
    nums = _rule_numbers(pack)
    chunks = []
    for layer in LAYERS:
        rules = PACKS[pack][layer]
        conds = _conditions(layer, rules, s, d, t)
        for i in range(0, len(rules), CHUNK):
            items = ", ".join(f"CASE WHEN {c} THEN {nums[(layer, rid)]} END" for c, rid in conds[i:i + CHUNK])
            guard = _guard(layer, rules[i:i + CHUNK], s, d, t)
            chunks.append(f"CASE WHEN {guard} THEN array({items}) ELSE CAST(array() AS ARRAY<INT>) END")
    table = ", ".join(f"named_struct('layer', {_q(r['layer'])}, 'layer_no', {r['layer_no']}, 'ord', {r['ord']}, "
                      f"'decision', {_q(r['decision'])}, 'rule_id', {_q(r['rule_id'])})" for r in pack_rows(pack))
    return (f"transform(filter(flatten(array({', '.join(chunks)})), _x -> _x IS NOT NULL), "
            f"_n -> array({table})[_n - 1])")


def all_hits(df: DataFrame, pack: str = DEFAULT_PACK, out: str = "hits") -> DataFrame:
    """Every rule that fires on a mail (shadowed ones too), in order, as an array."""
    s, d, t = normalize_inputs(F.col("sender"), F.col("sender_domain"), F.col("subject"))
    cur = df.withColumns({"_rs": s, "_rd": d, "_rt": t})
    cur = cur.select("*", F.explode(F.array(F.expr(all_hits_sql("_rs", "_rd", "_rt", pack)))).alias(out))
    return cur.drop("_rs", "_rd", "_rt")


def read_later(sender, domain) -> Column:
    """Read-later sender, on domain or full sender (inputs as given, null -> '')."""
    p = spark_regex(READ_LATER_PATTERN)
    return F.coalesce(domain, F.lit("")).rlike(p) | F.coalesce(sender, F.lit("")).rlike(p)


def rule_table(spark, pack: str = DEFAULT_PACK) -> DataFrame:
    """The pack as a small DataFrame (<= a few hundred rows)."""
    return spark.createDataFrame(pack_rows(pack),
                                 "pack string, layer string, layer_no int, ord int, decision string, "
                                 "rule_id string, reason string, pattern string, pattern2 string")


GRAM = 4
_CUT = "\u0002"


def folded(c: Column) -> Column:
    """One form for texts that a case-insensitive regex takes as equal (letters whose other case has another length too)."""
    return F.lower(F.upper(F.translate(c, "\u0130", "i")))


def required_grams(pattern: Column) -> Column:
    """For each alternative of a regex, ``GRAM`` characters that a matching text must hold; null where there are none.

    Groups, classes, escapes other than of punctuation, and repeated or optional characters say nothing here: they
    split the alternative, and its longest run of plain characters gives the piece. Nested groups deeper than two,
    look-arounds and runs shorter than ``GRAM`` give null (the rule then has to be tried on every mail).
    """
    p = F.regexp_replace(pattern, r"\\([.@_-])", "\u0001$1")                       # escaped punctuation: a plain character
    p = F.regexp_replace(p, r"\\.(?:[?*+]|\{[^}]*\})?", _CUT)
    p = F.regexp_replace(p, r"\[[^\]]*\](?:[?*+]|\{[^}]*\})?", _CUT)
    for _ in range(2):
        p = F.regexp_replace(p, r"\([^()]*\)(?:[?*+]|\{[^}]*\})?", _CUT)
    odd = p.rlike(r"[()\[\]]")
    runs = F.transform(F.split(p, r"\|"), lambda a: F.split(F.regexp_replace(F.regexp_replace(F.regexp_replace(
        a, "\u0001?.(?:[?*]|\\{[^}]*\\})", _CUT), "(?<!\u0001)[.^$+]", _CUT), "\u0001", ""), _CUT))
    longest = F.transform(runs, lambda r: F.reduce(r, F.lit(""), lambda x, y: F.when(F.length(y) > F.length(x), y).otherwise(x)))
    plain = F.transform(longest, lambda x: F.when((F.length(x) >= GRAM) & x.rlike(r"^[\x20-\x7E]+$"), F.substring(folded(x), 1, GRAM)))
    return F.when(~odd & F.forall(plain, lambda x: x.isNotNull()), F.array_distinct(plain))


def rule_keys(rules: DataFrame) -> DataFrame:
    """``rules`` plus (field, gram), one row for each text and piece that leads to the rule; nulls where a rule has no piece.

    Fields: s (From text), d (domain), t (subject). A combo rule needs its sender pattern's piece, or else its subject's.
    """
    g, g2 = required_grams(F.col("pattern")), required_grams(F.coalesce("pattern2", F.lit("")))
    layer = F.col("layer")
    fields = (F.when(layer == "combo", F.when(F.col("_g").isNotNull(), F.array(F.lit("s"))).otherwise(F.array(F.lit("t"))))
              .when(layer == "keep_domain", F.array(F.lit("d"), F.lit("s"))).when(layer == "keep_subject", F.array(F.lit("t")))
              .otherwise(F.array(F.lit("d"))))
    own = F.when((layer == "combo") & F.col("_g").isNull(), F.col("_g2")).otherwise(F.col("_g"))
    t = rules.withColumns({"_g": g, "_g2": g2}).withColumns({"_fields": fields, "_own": own}).drop("_g", "_g2")
    return t.withColumn("field", F.explode("_fields")).withColumn("gram", F.explode_outer("_own")).drop("_fields", "_own")


def _matches() -> Column:
    """Whether a mail's texts (_s, _d, _t) match the rule beside them."""
    rl = lambda c, p: F.regexp_like(F.col(c), F.concat(F.lit("(?iUd)"), F.col(p)))
    return (F.when(F.col("layer") == "combo", rl("_s", "pattern") & rl("_t", "pattern2"))
            .when(F.col("layer") == "keep_domain", rl("_d", "pattern") | rl("_s", "pattern"))
            .when(F.col("layer") == "keep_subject", rl("_t", "pattern")).otherwise(rl("_d", "pattern")))


def rule_candidates(emails: DataFrame, keys: DataFrame, id_col: str = "id") -> DataFrame:
    """Each mail beside the rules whose piece one of its texts holds: the only pairs on which a regex runs."""
    s, d, t = normalize_inputs(F.col("sender"), F.col("sender_domain"), F.col("subject"))
    m = emails.select(F.col(id_col).alias("_id"), s.alias("_s"), d.alias("_d"), t.alias("_t"))
    # four bytes a character, so that a piece is found by its place; made once, behind a one-row generator
    wide = F.struct(*[F.encode(folded(F.col(f"_{f}")), "UTF-32").alias(f) for f in "sdt"])
    m = m.select("*", F.explode(F.array(wide)).alias("_w"))

    def pieces(f: str) -> Column:
        w = F.col(f"_w.{f}")
        places = F.sequence(F.lit(0), F.greatest(F.floor(F.octet_length(w) / 4).cast("int") - GRAM, F.lit(0)))
        found = F.array_distinct(F.transform(places, lambda i: F.xxhash64(F.substring(w, i * 4 + 1, F.lit(GRAM * 4)))))
        return F.transform(found, lambda x: F.struct(F.lit(f).alias("field"), x.alias("_gram")))

    held = m.select("_id", "_s", "_d", "_t", F.inline(F.concat(*[pieces(f) for f in "sdt"])))
    led = keys.where("gram is not null").withColumn("_gram", F.xxhash64(F.encode("gram", "UTF-32"))).drop("gram")
    return held.join(led, ["field", "_gram"]).drop("field", "_gram")


def first_hit_index(emails: DataFrame, rules: DataFrame, id_col: str = "id") -> DataFrame:
    """R5 for rule tables of any size, without trying every rule on every mail; the result of ``apply_rules``.

    Rules without a required piece (``required_grams``) are tried on all mail by ``first_hit_table``; there should be few.
    """
    keys = cut(rule_keys(rules), "rule-keys")
    pick = lambda h: h.groupBy("_id").agg(F.min_by(F.struct("decision", "rule_id", "reason"), F.struct("layer_no", "ord")).alias("h"),
                                          F.min(F.struct("layer_no", "ord")).alias("o"))
    found = pick(rule_candidates(emails, keys, id_col).where(_matches()))
    rest = keys.where("gram is null").drop("field", "gram").distinct()
    if rest.head(1):
        s, d, t = normalize_inputs(F.col("sender"), F.col("sender_domain"), F.col("subject"))
        m = emails.select(F.col(id_col).alias("_id"), s.alias("_s"), d.alias("_d"), t.alias("_t"))
        small = rest.limit(RULE_TABLE_BROADCAST_MAX + 1).count() <= RULE_TABLE_BROADCAST_MAX
        found = found.unionByName(pick(m.join(F.broadcast(rest) if small else rest, _matches())))
        found = found.groupBy("_id").agg(F.min_by("h", "o").alias("h"))
    hits = found.select("_id", F.col("h").alias("hit"))
    return emails.join(hits, emails[id_col] == hits["_id"], "left").drop("_id")


def first_hit_table(emails: DataFrame, rules: DataFrame, id_col: str = "id") -> DataFrame:
    """R5 for large rule tables: broadcast nested-loop join of mails x rules.

    The rule table is broadcast: its size is bounded by rule authoring, not by
    the mail volume (``RULE_TABLE_BROADCAST_MAX``). Every hit is found with
    ``rlike`` on the pattern column and the first hit per mail is kept by
    ``min_by`` over (layer, ord), a partial aggregation over hits only. Mails
    without a hit get null. Same result as ``apply_rules``.
    """
    s, d, t = normalize_inputs(F.col("sender"), F.col("sender_domain"), F.col("subject"))
    m = emails.select(F.col(id_col).alias("_id"), s.alias("_s"), d.alias("_d"), t.alias("_t"))
    r = rules.select("layer", "layer_no", "ord", "decision", "rule_id", "reason",
                     F.concat(F.lit("(?iUd)"), "pattern").alias("p1"),
                     F.concat(F.lit("(?iUd)"), "pattern2").alias("p2"))
    rl = lambda c, p: F.regexp_like(F.col(c), F.col(p))
    cond = (F.when(F.col("layer") == "combo", rl("_s", "p1") & rl("_t", "p2"))
            .when(F.col("layer") == "keep_domain", rl("_d", "p1") | rl("_s", "p1"))
            .when(F.col("layer") == "keep_subject", rl("_t", "p1"))
            .otherwise(rl("_d", "p1")))
    # the rule table is broadcast only behind a size check; a larger table is
    # joined without the hint (Spark then picks the strategy from its statistics)
    small = rules.limit(RULE_TABLE_BROADCAST_MAX + 1).count() <= RULE_TABLE_BROADCAST_MAX
    hits = (m.join(F.broadcast(r) if small else r, cond, "inner")
            .groupBy("_id")
            .agg(F.min_by(F.struct("decision", "rule_id", "reason"),
                          F.struct("layer_no", "ord")).alias("hit")))
    return emails.join(hits, emails[id_col] == hits["_id"], "left").drop("_id")
