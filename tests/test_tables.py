"""Splits, ranks, de-duplication, metrics, augmentation, sinks, history."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from baitline.functions import fixed_values as fv
from baitline.functions.urls import with_url_parts
from baitline.operators import audit, augment, cleaning, dedup, history, metrics, ranking, scanning, splits
from baitline.sources import corpus
from baitline.sources import tables as t
from baitline.streaming import jobs


def test_running_totals_with_hot_value(spark):
    rng = random.Random(1)
    counts = Counter(round(rng.random() ** 4, 3) for _ in range(5000))
    df = spark.createDataFrame([(v, n) for v, n in counts.items()], "v double, n long")
    got = {r["v"]: r["before_n"] for r in ranking.running_totals(df, "v", ["n"], buckets=7).collect()}
    seen, want = 0, {}
    for v in sorted(counts):
        want[v] = seen
        seen += counts[v]
    assert got == want


def test_chunked_row_number(spark):
    df = spark.range(1000).select(F.when(F.col("id") % 10 < 7, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 3)).alias("g"), "id")
    got = ranking.chunked_row_number(df, ["g"], ["id"], "rn", chunks=5).collect()
    per = {}
    for r in sorted(got, key=lambda r: (r["g"], r["id"])):
        per[r["g"]] = per.get(r["g"], 0) + 1
        assert r["rn"] == per[r["g"]]


@pytest.mark.parametrize("n", [1, 2, 7, 100, 1001])
def test_stratified_shares(spark, n):
    df = spark.range(n).select(F.concat(F.lit("https://h"), F.col("id")).alias("url"), F.lit(0).alias("label"))
    c = Counter(r["split"] for r in splits.stratified_split(df).collect())
    held = -(-n * 3 // 10)
    assert (c["train"], c["validation"], c["test"]) == (n - held, held - -(-held // 2), -(-held // 2))


def test_group_split_keeps_groups_whole(spark, folder):
    hosts = audit.with_host(t.urls(spark, folder))
    for fn in (splits.group_split, splits.hashed_group_split):
        per = fn(hosts, "domain").groupBy("domain").agg(F.countDistinct("split").alias("n"))
        assert per.where("n > 1").count() == 0


def test_exact_median(spark):
    rng = random.Random(2)
    rows = [("a", rng.gauss(0, 1)) for _ in range(501)] + [("b", float(rng.randrange(5))) for _ in range(400)]
    rows += [("c", 1.5), ("c", None), ("d", 1.0), ("d", 2.0)]
    df = spark.createDataFrame(rows, "k string, v double")
    import statistics
    want = {k: statistics.median(v for kk, v in rows if kk == k and v is not None) for k in "abcd"}
    assert {r["k"]: r["median"] for r in audit.exact_median(df, "k", "v", buckets=16).collect()} == pytest.approx(want)


def test_auc_and_ap_by_brute_force(spark):
    rng = random.Random(3)
    rows = [(int(rng.random() < 0.4), round(rng.random(), 1)) for _ in range(300)]
    df = spark.createDataFrame(rows, "label int, probability double")
    pos, neg = [p for l, p in rows if l], [p for l, p in rows if not l]
    auc = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / len(pos) / len(neg)
    assert metrics.roc_auc(df).first()["roc_auc"] == pytest.approx(auc)
    ap = 0.0
    for s in sorted({p for _, p in rows}, reverse=True):
        at_least = [l for l, p in rows if p >= s]
        ap += sum(l for l, p in rows if p == s) / len(pos) * sum(at_least) / len(at_least)
    assert metrics.average_precision(df).first()["average_precision"] == pytest.approx(ap)
    single = df.where("label = 1")
    assert metrics.roc_auc(single).first()["roc_auc"] is None
    assert metrics.binary_metrics(single.withColumn("prediction", F.lit(0))).first()["precision"] == 0.0


def test_positive_label_is_an_argument(spark):
    df = spark.createDataFrame([(1, 1), (1, 0), (0, 0)], "label int, prediction int")
    assert metrics.binary_metrics(df).first()["recall"] == 0.5
    assert metrics.binary_metrics(df, positive_label=0).first()["recall"] == 1.0


def test_stages_win_collisions(spark):
    stage = lambda rows: spark.createDataFrame(rows, "url string, ord int, tag string")
    out = dedup.staged_union([stage([("u", 9, "first")]), stage([("u", 1, "second"), ("v", 1, "second")])])
    assert {(r["url"], r["tag"]) for r in out.collect()} == {("u", "first"), ("v", "second")}


def test_www_leak_is_reported(spark):
    df = spark.createDataFrame([("https://x.com/a", "train"), ("https://www.x.com/b", "test")], "url string, split string")
    from baitline.functions.urls import registered_domain
    hosts = audit.with_host(df).withColumn("registered", registered_domain(F.col("host")))
    shared = lambda key: {(r["left_split"], r["right_split"]): r["shared"] for r in dedup.cross_split_overlap(hosts, key).collect()}
    assert shared("domain")[("train", "test")] == 0
    assert shared("registered")[("train", "test")] == 1


def test_mutations_keep_contract(spark, folder):
    out = augment.mutate_urls(t.probes(spark, folder).where("variant IN (0, 1, 5, 14)"), 9)
    rows = with_url_parts(out).select("page_id", "variant", "original_url", "url", "normalized_url").collect()
    assert all(r["url"] != r["original_url"] and r["url"] == r["normalized_url"] for r in rows)
    assert len({(r["page_id"], r["variant"], r["url"]) for r in rows}) == len(rows)


def test_marker_re_encodes(spark):
    df = spark.createDataFrame([("a=%2F b&&c&d=~*&e=100%",), ("ref=1",), ("",)], "q string")
    got = [r[0] for r in df.select(augment.marked_query(F.col("q"))).collect()]
    assert got == ["a=%2F+b&c=&d=~%2A&e=100%25&ref=internal", "ref=1", "ref=internal"]


def test_addresses_and_odd_parts_survive_augmentation(spark):
    urls = ["http://[2001:db8::1]/x", "https://user:pw@example.com:8443/a?b=1#c", "http://192.168.1.10:81/login"]
    df = spark.createDataFrame([(u, 1, i) for i, u in enumerate(urls)], "url string, label int, ord int")
    rows = augment.robust_split(df, 9).select("url", "original_url", "augmentation_source").collect()
    assert {r["original_url"] for r in rows} == set(urls)
    assert not any("[www." in r["url"] for r in rows)
    assert all(sum(r["original_url"] == u for r in rows) >= 5 for u in urls)


def test_stock_cases(spark):
    negatives, positives = augment.stock_hard_cases(spark)
    assert (negatives.count(), positives.count()) == (9600, 500)
    assert negatives.select("url").distinct().count() == 9600
    assert augment.behaviour_corpus(spark).groupBy("label").count().count() == 2
    cases = augment.sensitivity_cases(spark).withColumn("probability", F.col("variant") / 10)
    assert augment.score_deltas(cases).where("variant = 3").first()["delta"] == pytest.approx(0.3)


def test_cleaning(spark):
    rows = [(" 1", "5", None, "x", "1"), (" 1", "5", None, "x", "1"), ("3", "inf", None, "x", "0"), (None,) * 5, ("9", "7", None, "x", "2")]
    df = spark.createDataFrame(rows, "`a b` string, b string, gone string, words string, label string")
    out = cleaning.clean_feature_table(df)
    assert out.columns == ["a_b", "b", "label"]
    assert sorted(map(tuple, out.collect())) == [(1.0, 5.0, 1), (3.0, 5.0, 0)]
    assert cleaning.drop_constant_features(out).columns == ["a_b", "label"]


def test_sinks_round_trip(spark, folder, tmp_path):
    df = splits.stratified_split(t.labelled_urls(spark, folder))
    corpus.write_splits(df, f"{tmp_path}/splits")
    assert corpus.read_split(spark, f"{tmp_path}/splits", "test").count() == df.where("split = 'test'").count()
    df.select(F.col("url").alias("URL"), "label", F.lit("x").alias("extra")).write.option("header", True).csv(f"{tmp_path}/raw")
    assert corpus.read_corpus(spark, f"{tmp_path}/raw").count() == df.count()
    with pytest.raises(ValueError):
        corpus.write_report(df.select("url"), f"{tmp_path}/bad", "csv")
        corpus.read_corpus(spark, f"{tmp_path}/bad")
    corpus.write_report(corpus.feature_schema_table(spark, "m"), f"{tmp_path}/schema")
    assert spark.read.json(f"{tmp_path}/schema").first()["feature_count"] == len(fv.FEATURE_NAMES)


def test_scan_history_and_replay(spark, folder, tmp_path):
    asked = t.scan_requests(spark, folder).select("event_id", "ts", "url").limit(300)
    asked = asked.withColumn("url", F.when(F.col("event_id") % 10 == 0, "bad url").otherwise(F.col("url")))
    good, bad = scanning.scan(asked)
    n_good, n_bad = good.count(), bad.count()
    assert n_good + n_bad == asked.count() and n_bad > 0
    rows = history.history_rows(good)
    assert {f.name: f.dataType.simpleString() for f in rows.schema} == history.HISTORY_COLUMNS
    corpus.append_scans(rows, f"{tmp_path}/history")
    corpus.append_scans(rows, f"{tmp_path}/history")
    stored = corpus.read_history(spark, f"{tmp_path}/history")
    stats = history.scan_stats(stored).first()
    assert stats["total"] == 2 * n_good == stats["safe"] + stats["suspicious"] + stats["phishing"]
    assert history.scan_stats(stored, case_sensitive=True).first()["safe"] == 0
    assert history.recent_scans(stored, 1).count() == 1
    with pytest.raises(ValueError):
        history.recent_scans(stored, 0)
    for _ in range(2):
        corpus.append_scan_batch(rows, 7, f"{tmp_path}/stream")
    assert corpus.read_history(spark, f"{tmp_path}/stream").count() == n_good
    assert scanning.scan_distinct(asked).count() == n_good


def test_score_stream(spark, folder, tmp_path):
    asked = t.scan_requests(spark, folder).select("event_id", "ts", "url")
    asked.repartition(2).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(asked.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    writer = jobs.score_stream(stream, f"{tmp_path}/history", f"{tmp_path}/rejected", f"{tmp_path}/cp")
    query = writer.start()
    query.processAllAvailable()
    query.stop()
    assert corpus.read_history(spark, f"{tmp_path}/history").count() == asked.count()
