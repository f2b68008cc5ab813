"""Reports and the states of their analyses against plain loops."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from baitline.operators import intel, scanning
from baitline.operators.risk import MSG_INTEL_DISABLED, MSG_INTEL_ERROR
from baitline.plans import inputs as i
from baitline.streaming import jobs

UPDATE = "update_id long, url string, at timestamp, state string, malicious int, suspicious int, harmless int, undetected int"
BASE = dt.datetime(2024, 1, 1)
at = lambda s: None if s is None else BASE + dt.timedelta(seconds=s)


@pytest.fixture(scope="module")
def news(spark):
    """A URL with most rows, rare ones, equal times, and updates without id, URL, time or state."""
    draw = random.Random(11)
    states = ["completed", "queued", "in-progress", "error", "error", None]
    updates = [
        (n, draw.choice(["HTTP://hot.example/ "] * 6 + ["http://a.example", "http://b.example"]), draw.randrange(0, 4000, 5), draw.choice(states),
         draw.randrange(4), draw.randrange(3), draw.randrange(9), draw.randrange(5))
        for n in range(300)
    ] + [(None, "http://a.example", 5, "completed", 1, 1, 1, 1), (900, None, 5, "completed", 1, 1, 1, 1), (901, "http://a.example", None, "completed", 1, 1, 1, 1)]
    scans = [(n, draw.choice(["http://hot.example/"] * 6 + ["http://a.example", "http://none.example"]), draw.randrange(0, 4200, 5), n % 7 != 3)
             for n in range(400)] + [(1000, None, 5, True), (1001, "http://a.example", None, True), (1002, "http://a.example", 50, None)]
    return updates, scans


def seen_by(updates, scan, deadline, lifetime):
    _, url, ts, wanted = scan
    if url is None or ts is None or not wanted:
        return None
    near = [u for u in updates if None not in u[:3] and u[1].strip().lower() == url and ts - lifetime < u[2] <= ts + deadline]
    return max(near, key=lambda u: (u[3] == "completed", u[2], u[0]), default=None)


@pytest.mark.parametrize(("chunks", "deadline", "lifetime"), [(1, 30, 100), (9, 30, 100), (5, 0, 20), (16, 60, 100_000)])
def test_seen_as_of(spark, news, chunks, deadline, lifetime):
    updates, scans = news
    given = spark.createDataFrame([(u[0], u[1], at(u[2]), *u[3:]) for u in updates], UPDATE)
    asked = spark.createDataFrame([(n, u, at(s), w, "clash") for n, u, s, w in scans], "event_id long, url string, ts timestamp, wanted boolean, state string")
    out = intel.reports_seen(asked, given, deadline=deadline, lifetime=lifetime, wanted=F.col("wanted"), chunks=chunks).collect()
    assert len(out) == len(scans)
    statuses = set()
    for r in out:
        scan = next(s for s in scans if s[0] == r["event_id"])
        u = seen_by(updates, scan, deadline, lifetime)
        assert r["intel_seen_id"] == (u[0] if u else None) and r["state"] == "clash"
        state = u[3] if u else None
        want = "disabled" if not scan[3] else "unavailable" if state is None else "success" if state == "completed" else state
        assert r["intel_status"] == want
        counts = list(u[4:]) if state not in (None, "error") else [0] * 4
        assert [r[c] for c in intel.COUNTED] == counts and r["total_engines"] == sum(counts)
        score = round(min(100.0, (counts[0] + counts[1] / 2) * 100 / sum(counts)), 2) if sum(counts) else 0.0
        assert r["intel_score"] == pytest.approx(score, abs=0.006)
        assert any("did not complete" in m for m in r["intel_reasons"]) == (state in ("queued", "in-progress"))
        statuses.add(want)
    assert statuses >= {"success", "error", "queued", "in-progress", "unavailable", "disabled"} - ({"queued", "in-progress"} if lifetime > 5000 else set())


def test_seen_of_nothing(spark):
    none = spark.createDataFrame([], UPDATE)
    asked = spark.createDataFrame([(1, "http://a.example", BASE)], "event_id long, url string, ts timestamp")
    assert [r["intel_status"] for r in intel.reports_seen(asked, none).collect()] == ["unavailable"]
    assert intel.reports_seen(asked.limit(0), none).collect() == []


def test_no_engine_no_score(spark):
    report = intel.threat_report_from_verdicts(spark.createDataFrame([("u", "e", "timeout")], "url string, engine string, verdict string"))
    assert report.first()["threat_score"] == 0.0


def test_settled(spark):
    verdicts = spark.createDataFrame([(u, "e", v) for u in "abcd" for v in ("malicious", "harmless")], "url string, engine string, verdict string")
    states = spark.createDataFrame([("a", "completed"), ("b", "queued"), ("c", "error")], "url string, state string")
    got = {r["url"]: r for r in intel.settled_reports(intel.threat_report_from_verdicts(verdicts), states).collect()}
    assert [got[u]["status"] for u in "abcd"] == ["success", "queued", "error", "success"]
    assert [got[u]["malicious"] for u in "abcd"] == [1, 1, 0, 1] and got["c"]["reasons"] == [] and "queued" in got["b"]["reasons"][0]


def test_every_state_and_message_occurs(spark, folder):
    rows = i.assessed_probes(spark, folder).select("intel_status", "reasons").collect()
    assert {r["intel_status"] for r in rows} == {"success", "error", "queued", "unavailable", "disabled"}
    for status, message in (("error", MSG_INTEL_ERROR), ("disabled", MSG_INTEL_DISABLED)):
        assert all((message in r["reasons"]) == (r["intel_status"] == status) for r in rows)


def written(spark, rows, schema, order, path, parts, end):
    """A stream of files of rows in ``order``, one a batch; ``end`` is a last row that moves the watermark."""
    rows = sorted(rows, key=order)
    size = -(-len(rows) // parts)
    for part in [*(rows[n * size:(n + 1) * size] for n in range(parts)), [end]]:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_stream_equals_batch_and_scores(spark, news, tmp_path):
    """Scans and updates arrive out of order within the watermark; what each saw, and its verdict, is what batch says."""
    updates, scans = news
    scan_schema = "event_id long, url string, ts timestamp, wanted boolean"
    given = [(u[0], u[1], at(u[2]), *u[3:]) for u in updates if None not in u[:3]]
    asked = [(n, u, at(s), w) for n, u, s, w in scans if s is not None]
    shuffled = lambda row: (row[0] * 7919) % 1009
    end = at(900_000)
    scan_stream = written(spark, asked, scan_schema, shuffled, str(tmp_path / "scans"), 3, (-1, "http://end.example", end, True))
    update_stream = written(spark, given, UPDATE, shuffled, str(tmp_path / "updates"), 2, (999_999, "http://end.example", end, "error", 0, 0, 0, 0))
    settings = {"deadline": 30, "lifetime": 100, "wanted": F.col("wanted")}
    seen = jobs.reports_seen_stream(scan_stream, update_stream, watermark="2 hours", **settings)
    query = seen.writeStream.format("memory").queryName("seen").outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    batch = intel.reports_seen(spark.createDataFrame(asked, scan_schema), spark.createDataFrame(given, UPDATE), **settings)
    rows = lambda df: sorted(map(str, df.select(*sorted(batch.columns)).collect()))
    assert rows(spark.table("seen").where("event_id >= 0")) == rows(batch)

    scorer = scanning.logistic_scorer(i.URL_WEIGHTS, i.HOST_WEIGHTS, i.URL_BIAS, i.HOST_BIAS)
    whole, _ = scanning.scan(batch, scorer, lookup=lambda df: df)
    spark.table("seen").coalesce(1).write.parquet(str(tmp_path / "rows"))
    source = spark.readStream.schema(spark.table("seen").schema).parquet(str(tmp_path / "rows"))
    out = [str(tmp_path / p) for p in ("history", "quarantine", "checkpoint")]
    writer = jobs.score_stream(source.where("event_id >= 0"), *out, scorer=scorer, lookup=lambda df: df)
    query = writer.start()
    query.processAllAvailable()
    query.stop()
    made = spark.read.parquet(out[0])
    assert made.count() == whole.count() and set(made.select("risk_level").distinct().collect()) == set(whole.select("risk_level").distinct().collect())
    assert spark.read.parquet(out[1]).count() == sum(u is None for _, u, s, _ in scans if s is not None)
