"""Lookups of tables of names against plain loops."""

import random
import re

import pytest
from pyspark.sql import functions as F

from baitline.functions.fixed_values import BRAND_DOMAINS, RULE_WORDS
from baitline.operators import joins, names
from baitline.plans import inputs as i


def column(spark, values, name):
    return spark.createDataFrame([(v,) for v in values], f"{name} string")


@pytest.mark.parametrize("gram", [1, 2, 3])
def test_substring_links(spark, gram):
    draw = random.Random(7)
    text = lambda low, high: "".join(draw.choice("ab.é") for _ in range(draw.randint(low, high)))
    texts = [*(text(0, 12) for _ in range(200)), None, "", "aaaaaa", "zzz"]
    listed = [*(text(0, 5) for _ in range(80)), None, "", "a", "zzzz", "aa"]
    got = names.substring_links(column(spark, texts * 2, "text"), column(spark, listed * 2, "name"), gram=gram).collect()
    want = {(x, n) for x in texts if x for n in listed if n and n in x}
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_links_of_nothing(spark):
    none, some = column(spark, [], "name"), column(spark, ["a"], "text")
    assert names.substring_links(some, none).collect() == []
    assert names.substring_links(none.withColumnRenamed("name", "text"), column(spark, ["a"], "name")).collect() == []


def test_no_nested_loop(spark, folder):
    hosts = i.normal_probes(spark, folder).select(F.col("host").alias("text"))
    plan = names.substring_links(hosts, column(spark, ["paypal"], "name"))._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_hot_run_and_hot_host(spark):
    """One host holds most rows and every host holds the run 'com'; names under rarer runs never meet them all."""
    rows = [("https://shop.example.com/a",)] * 300 + [(f"https://h{n}.example.com/",) for n in range(50)] + [("https://paypal.evil.com/",), (None,), ("",)]
    urls = spark.createDataFrame(rows, "url string").withColumn("brand", F.lit("a clash")).withColumn("domain", F.lit("a clash"))
    brands, owned = column(spark, ["PayPal", "com", "shop", None], "brand"), spark.createDataFrame([("shop", "Example.com"), ("com", None)], "brand string, domain string")
    out = names.brand_impersonation_by_table(urls, brands, owned).collect()
    assert len(out) == len(rows)
    for r in out:
        want = [b for b in ("com", "paypal", "shop") if r["host"] and b in r["host"] and b != "shop"]
        assert r["brand_matches"] == want and r["brand_impersonation"] == bool(want) and r["brand"] == "a clash"


def test_table_equals_list(spark, folder):
    """With the built-in lists as tables both lookups give what the in-row tests give."""
    base = i.normal_probes(spark, folder)
    owned = [(b, d) for b, domains in BRAND_DOMAINS.items() for d in domains]
    by_table = names.brand_impersonation_by_table(base, column(spark, list(BRAND_DOMAINS), "brand"), spark.createDataFrame(owned, "brand string, domain string"))
    by_list = joins.brand_impersonation(base)
    rows = lambda df, *c: sorted(map(str, df.select("page_id", "variant", *c).collect()))
    assert rows(by_table, "brand_matches", "brand_impersonation") == rows(by_list, "brand_matches", "brand_impersonation")
    words = names.suspicious_words_by_table(base, column(spark, [w.upper() for w in RULE_WORDS], "word"))
    assert rows(words, "rule_words") == rows(joins.suspicious_words(base), "rule_words")


def test_bounded_counts(spark):
    draw = random.Random(3)
    texts = ["".join(draw.choice(["ab", "a", "-", "_", "\\E", "é", "."]) for _ in range(draw.randint(0, 14))) for _ in range(150)] + ["", None]
    words = ["ab", "a", "ab-a", "-a", "a-", "a\\Ea", "é", "-", "", None, "_a", "a.a"]
    for letter in (names.FEATURE_CHAR, names.WORD_CHAR):
        as_python = letter.replace(r"[\p{L}\p{N}_]", r"[\w]")
        got = {(r["text"], r["word"]): r["n"] for r in names.bounded_counts(column(spark, texts, "text"), column(spark, words, "word"), letter).collect()}
        want = {}
        for x in filter(None, texts):
            for w in filter(None, words):
                n = len(re.findall(f"(?<!{as_python}){re.escape(w)}(?!{as_python})", x))
                if n and re.search(as_python, w):
                    want[x, w] = n
        assert got == want
