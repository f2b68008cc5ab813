"""Names of a table found inside texts, without comparing every text with every name.

Both lookups are equi-joins on a key that a match must share: a run of characters for
names anywhere in a text, a whole word for names bounded by other characters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from baitline.functions import urls as ur
from baitline.operators.rules import WORD_CHAR

#: Length of the character runs that index the names; a shorter name is its own run.
GRAM = 3
#: Characters that make words for the feature count.
FEATURE_CHAR = "[a-z0-9]"


def grams(text: Column, size: Column) -> Column:
    """Distinct runs of ``size`` characters."""
    last = F.length(text) - size + 1
    return F.when(last > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), last), lambda i: F.substr(text, i, size))))


def substring_links(texts: DataFrame, names: DataFrame, text: str = "text", name: str = "name", gram: int = GRAM) -> DataFrame:
    """Distinct (``text``, ``name``) with the name anywhere inside the text.

    An inverted index: every text is listed under its runs of characters, every name
    under the one of its runs that the fewest texts have, so a run that nearly all texts
    share is not a key unless a name holds nothing rarer. A name with a run that no text
    has is not looked up at all. Null and empty texts and names take no part; the two columns need different names.
    """
    asked = texts.select(text).where(F.length(text) > 0).distinct()
    listed = names.select(name).where(F.length(name) > 0).distinct()
    runs = F.flatten(F.array(*[F.coalesce(grams(F.col(text), F.lit(s)), F.array().cast("array<string>")) for s in range(1, gram + 1)]))
    text_runs = asked.select(text, F.explode(runs).alias("_run"))
    name_runs = listed.select(name, F.explode(grams(F.col(name), F.least(F.length(name), F.lit(gram)))).alias("_run"))
    holders = text_runs.groupBy("_run").agg(F.count(F.lit(1)).alias("_n"))
    # packed as (count, run) so that the smallest is one value
    rarest = name_runs.join(holders, "_run", "left").groupBy(name).agg(
        F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), F.col("_run").alias("run"))).alias("_key")
    )
    keyed = rarest.where("_key.n > 0").select(name, F.col("_key.run").alias("_run"))
    return text_runs.join(keyed, "_run").where(F.col(text).contains(F.col(name))).select(text, name)


def brand_impersonation_by_table(
    df: DataFrame, brands: DataFrame, owned: DataFrame, url_col: str = "url", brand: str = "brand", domain: str = "domain",
) -> DataFrame:
    """Append sorted ``brand_matches`` and ``brand_impersonation`` for a table of brands of any length.

    ``brands`` lists names, ``owned`` (name, registered domain) pairs that may use them. Names and domains are compared in lower case.
    Distinct hosts are looked up, owned pairs leave by an anti join, and each host's
    list (at most the substrings of one host) goes back to its URLs. A URL without a host has an empty list.
    """
    base = ur.parsed(df, url_col)
    host = ur.stripped_host(F.col("host"))
    hosts = base.select(host.alias("_host")).where("_host IS NOT NULL").distinct()
    links = substring_links(hosts, brands.select(F.lower(F.col(brand)).alias("_brand")), "_host", "_brand")
    allowed = owned.select(F.lower(F.col(brand)).alias("_brand"), F.lower(F.col(domain)).alias("_domain")).distinct()
    foreign = links.withColumn("_domain", ur.registered_domain(F.col("_host"))).join(allowed, ["_brand", "_domain"], "left_anti")
    found = foreign.groupBy("_host").agg(F.sort_array(F.collect_list("_brand")).alias("_found"))
    matches = F.coalesce("_found", F.array().cast("array<string>"))
    return (
        base.withColumn("_host", host).join(found, "_host", "left")
        .withColumns({"brand_matches": matches, "brand_impersonation": F.size(matches) > 0})
        .select(*base.columns, "brand_matches", "brand_impersonation")
    )


def bounded_counts(texts: DataFrame, words: DataFrame, letter: str, text: str = "text", word: str = "word") -> DataFrame:
    """(``text``, ``word``, ``n``): how often each word stands in each distinct text without a ``letter`` on either side.

    The first run of letters inside a word is a whole run of any text that holds the
    word, so it is the join key; only words of more than that run are searched for. Words without a letter are never found.
    """
    run = f"({letter}+)"
    found = F.explode(F.regexp_extract_all(F.col(text), F.lit(run), F.lit(1)))
    runs = texts.select(text).where(F.col(text).isNotNull()).distinct().select(text, found.alias("_run"))
    runs = runs.groupBy(text, "_run").agg(F.count(F.lit(1)).alias("_n"))
    listed = words.select(word).where(F.col(word).isNotNull()).distinct().withColumn("_run", F.regexp_extract(word, run, 1))
    quoted = F.concat(F.lit(f"(?<!{letter})\\Q"), F.replace(F.col(word), F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit(f"\\E(?!{letter})"))
    n = F.when(F.col(word) == F.col("_run"), F.col("_n")).otherwise(F.regexp_count(F.col(text), quoted))
    return runs.join(listed.where("_run <> ''"), "_run").select(text, word, n.cast("long").alias("n")).where("n > 0")


def suspicious_words_by_table(df: DataFrame, words: DataFrame, url_col: str = "url", word: str = "word") -> DataFrame:
    """Append ``feature_words`` (different words) and ``rule_words`` (occurrences of all words) for a table of words.

    The two counts draw a word's borders differently, as those of the built-in lists do. Each word counts by
    itself, also inside a longer listed one. Words are compared in lower case.
    """
    base = ur.parsed(df, url_col)
    texts = base.select(F.lower("normalized_url").alias("_text")).distinct()
    listed = words.select(F.lower(F.col(word)).alias("_word"))
    feature = bounded_counts(texts, listed, FEATURE_CHAR, "_text", "_word").select("_text", F.lit(1).cast("long").alias("_f"), F.lit(0).cast("long").alias("_r"))
    rule = bounded_counts(texts, listed, WORD_CHAR, "_text", "_word").select("_text", F.lit(0).cast("long").alias("_f"), F.col("n").alias("_r"))
    per = feature.unionByName(rule).groupBy("_text").agg(F.sum("_f").alias("_f"), F.sum("_r").alias("_r"))
    return (
        base.withColumn("_text", F.lower("normalized_url")).join(per, "_text", "left")
        .withColumns({"feature_words": F.coalesce("_f", F.lit(0)).cast("int"), "rule_words": F.coalesce("_r", F.lit(0)).cast("int")})
        .select(*base.columns, "feature_words", "rule_words")
    )
