"""R5 by an index over the patterns: the same hits, few candidates."""
from __future__ import annotations

import random
import re

import pytest
from paths import SF_SMALL
from pyspark.sql import functions as F

from mailtriage.operators import rules as R
from mailtriage.sources import fixtures as fx

MAIL = "id string, sender string, sender_domain string, subject string"


@pytest.mark.parametrize("pattern,want", [
    (r"@vercel\.com$", {"@ver"}), (r"(^|\.)amazon\.de$", {"amaz"}), ("rechnung|invoice", {"rech", "invo"}), ("a|invoice", None),
    (r"\bsale\b", {"sale"}), ("colou?rs", {"colo"}), ("ab+cdefg", {"cdef"}), ("(?:x(y|z))?newsletter", {"news"}), ("[abc]def", None),
    ("x{2,3}orders", {"orde"}), (r"no\.reply", {"no.r"}), (r"a.c\.?", None), ("((a(b)))long literal", None), ("", None)])
def test_required_grams(spark, pattern, want):
    got = spark.createDataFrame([(pattern,)], "p string").select(R.required_grams(F.col("p")).alias("g")).first()["g"]
    assert (got and set(got)) == want


def test_grams_are_required(spark):
    """Whatever the pack's patterns match holds one of their pieces."""
    table = R.rule_table(spark).select("pattern", R.required_grams(F.col("pattern")).alias("g")).collect()
    mail = fx.raw_emails(spark, SF_SMALL).select("sender", "sender_domain", "subject").collect()
    texts = {t for m in mail for t in m if t}
    keyed = [r for r in table if r["g"]]
    assert len(keyed) > len(table) // 3
    for r in keyed:
        for t in texts:
            if re.search(r["pattern"], t, re.I):
                assert any(g in t.lower() for g in r["g"]), (r["pattern"], t)


def test_ten_thousand_rules(spark):
    r = random.Random(3)
    word = lambda: "".join(r.choices("abcdefghijklmnop", k=7))
    words = [word() for _ in range(10_000)]
    layers = ["combo", "keep_domain", "keep_subject", "deletable"]
    rules = []
    for k, w in enumerate(words):
        n = k % 4
        pattern = [rf"@{w}\\.com".replace("\\\\", "\\"), rf"(^|\.){w}\.(com|de)$", rf"\b{w}\b|{w}{w}", rf"{w}\.com$"][n]
        rules.append(("p", layers[n], n + 1, k, "keep" if n < 3 else "deletable", f"r{k}", "why", pattern, "offer" if n == 0 else None))
    rules += [("p", "keep_subject", 3, 20_000, "keep", "short", "why", "ab$", None), ("p", "deletable", 4, 20_001, "deletable", "class", "why", "^[q-z]+$", None)]
    cols = "pack string, layer string, layer_no int, ord int, decision string, rule_id string, reason string, pattern string, pattern2 string"
    table = spark.createDataFrame(rules, cols)
    mail = []
    for k in range(120):
        w, x = r.choice(words), r.choice(words)
        mail.append((str(k), f"Name <a@{w.upper()}.com>", f"{x}.com", f"Offer for {r.choice(words)}" if k % 3 else "nothing ab"))
    mail += [("n", None, None, None), ("e", "", "", ""), ("q", "qq", "qqrr", "ab"), ("i", "x", "y", words[2].replace("i", "\u0130") + " end")]
    df = spark.createDataFrame(mail, MAIL)
    got = {m["id"]: m["hit"] and m["hit"]["rule_id"] for m in R.first_hit_index(df, table).collect()}
    want = {m["id"]: m["hit"] and m["hit"]["rule_id"] for m in R.first_hit_table(df, table).collect()}
    assert got == want and len(got) == len(mail) and len(set(got.values())) > 50
    tried = R.rule_candidates(df, R.rule_keys(table)).count()
    assert tried < 0.02 * len(mail) * len(rules)
