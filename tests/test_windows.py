"""Anchored windows: scan route, distributed route, lookups, streams."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from baitline.operators import windows
from baitline.sources import tables as t
from baitline.streaming import jobs, limits

HOURS = 6 * 3600


def brute(rows, width):
    """rows: (key, at_us, id) -> {id: (start, position)}"""
    out, state = {}, {}
    for key, at, i in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        start, n = state.get(key, (None, 0))
        if start is None or at >= start + width:
            start, n = at, 0
        n += 1
        state[key] = (start, n)
        out[i] = (start, n)
    return out


@pytest.fixture(scope="module")
def events(spark):
    rng = random.Random(5)
    base = dt.datetime(2024, 1, 1)
    rows = []
    for i in range(3000):
        # one key holds most rows; timestamps repeat; some fall exactly on a window's end
        key = "hot" if i % 3 else f"k{i % 50}"
        rows.append((i, key, base + dt.timedelta(seconds=rng.randrange(0, 4000), milliseconds=rng.choice([0, 0, 500]))))
    for j in range(40):
        rows.append((3000 + j, "exact", base + dt.timedelta(seconds=60 * j)))
    return spark.createDataFrame(rows, "event_id long, client string, ts timestamp").cache()


def as_map(df):
    return {r["event_id"]: (r["window_start_us"], r["position"]) for r in df.collect()}


@pytest.mark.parametrize("chunks", [1, 8, 61])
def test_chunks_agree_with_brute_force(events, chunks):
    timed = events.withColumn("at_us", windows.micros("ts"))
    want = brute([(r["client"], r["at_us"], r["event_id"]) for r in timed.collect()], 60 * 10**6)
    got = windows.anchored_windows(events, "client", "ts", 60, ["event_id"], chunks=chunks)
    assert as_map(got) == want


@pytest.mark.parametrize("chunks", [1, 5])
def test_null_keys_are_a_key_of_their_own(spark, chunks):
    rows = [(1, None, 0), (2, "a", 5), (3, None, 20), (4, "n", 21), (5, None, 70), (6, "a", 30)]
    df = spark.createDataFrame(rows, "event_id long, url string, s long").withColumn("ts", F.timestamp_seconds("s"))
    out = windows.ttl_cache_events(df, order=["event_id"], seconds=60, chunks=chunks)
    got = {r["event_id"]: (r["url"], r["cache_hit"], r["position"], r["window_start_us"] // 10**6) for r in out.collect()}
    assert got == {
        1: (None, False, 1, 0), 3: (None, True, 2, 0), 5: (None, False, 1, 70), 2: ("a", False, 1, 5), 6: ("a", True, 2, 5), 4: ("n", False, 1, 21),
    }


def test_missing_client_is_unknown(spark):
    rows = [(1, None, "2024-01-01 00:00:00"), (2, "", "2024-01-01 00:00:01"), (3, "a", "2024-01-01 00:00:02")]
    df = spark.createDataFrame(rows, "event_id long, client string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    out = {r["event_id"]: r for r in windows.rate_limit(df, order=["event_id"], limit=1).collect()}
    assert out[2]["client"] == "unknown" and not out[2]["allowed"] and out[3]["allowed"]
    assert out[1]["reset_after"] == 60 and out[2]["reset_after"] == 59


def test_lookup_agrees_with_cache_run(events):
    run = windows.ttl_cache_events(events, "client", order=["event_id"], seconds=60)
    found = windows.cache_lookup(events, windows.stored_results(run, "client"), "client", seconds=60)
    a = {r["event_id"]: r["cached_from_us"] for r in run.select("event_id", "cached_from_us").collect()}
    assert {r["event_id"]: r["cached_from_us"] for r in found.collect()} == a


def test_job_latest_and_expiry(spark):
    rows = [
        (1, "a", "queued", "2024-01-01 00:00:00"), (2, "a", "completed", "2024-01-01 00:30:00"),
        (3, "b", "processing", "2024-01-01 00:00:00"), (4, "a", "failed", "2024-01-01 01:30:00"),
    ]
    df = spark.createDataFrame(rows, "event_id long, scan_id string, status string, at string").select(
        "event_id", "scan_id", "status", F.col("at").cast("timestamp").alias("updated_at"))
    latest = windows.job_latest(df, order=["event_id"]).collect()
    assert [(r["scan_id"], r["status"]) for r in latest] == [("a", "failed")]
    gaps = {(r["scan_id"], r["gap_us"]): r["expired_before"] for r in windows.job_expiry(df).collect()}
    assert gaps == {("a", None): False, ("b", None): False, ("a", 1800 * 10**6): False, ("a", 3600 * 10**6): True}


def lived(rows, ttl):
    """rows: (event_id, job, status, second) -> accepted ids with the second their job was queued; by a plain walk."""
    out, jobs_now = {}, {}
    for i, job, status, at in sorted(rows, key=lambda r: (r[3], r[0])):
        created, last = jobs_now.get(job, (None, None))
        if status == "queued":
            created = at
        elif created is None or at - last >= ttl:
            continue
        jobs_now[job] = (created, at)
        out[i] = created
    return out


@pytest.fixture(scope="module")
def lives(spark):
    rng = random.Random(11)
    rows = [(i, "hot" if i % 2 else f"j{i % 40}", rng.choice(["queued", "processing", "completed", "failed"]), rng.randrange(0, 20_000)) for i in range(1500)]
    rows += [(2000 + i, "steady", "queued" if i == 0 else "processing", 99 * i) for i in range(300)]
    rows += [(3000 + i, "never", "processing", 50 * i) for i in range(100)]
    frame = spark.createDataFrame(rows, "event_id long, scan_id string, status string, s long").withColumn("updated_at", F.timestamp_seconds("s")).cache()
    return rows, frame


@pytest.mark.parametrize("chunks", [1, 7, 40])
def test_job_states_renew_and_expire(lives, chunks):
    rows, frame = lives
    got = {r["event_id"]: r["created_at_us"] // 10**6 for r in windows.job_states(frame, seconds=100, chunks=chunks).where("accepted").collect()}
    assert got == lived(rows, 100) and any(i >= 2000 for i in got) and not any(i >= 3000 for i in got)


@pytest.mark.parametrize("chunks", [1, 9])
def test_polls_see_what_is_alive(spark, lives, chunks):
    rows, frame = lives
    asked = [(job, at) for job in ("hot", "j4", "j8", "steady", "never", "none") for at in range(0, 21_000, 37)]
    polls = spark.createDataFrame([*asked, (None, 5), ("hot", None)], "scan_id string, s long").withColumn("polled_at", F.timestamp_seconds("s"))
    got = {(r["scan_id"], r["s"]): (r["seen_id"], r["seen_us"]) for r in windows.job_seen_at(polls, frame, seconds=100, chunks=chunks).collect()}
    accepted = lived(rows, 100)
    want = {(None, 5): (None, None), ("hot", None): (None, None)}
    for job, at in asked:
        held = max(((s, i) for i, j, _, s in rows if j == job and s <= at and i in accepted), default=None)
        want[job, at] = (held[1], held[0] * 10**6) if held and at - held[0] < 100 else (None, None)
    assert got == want


def test_latest_alive(spark, lives):
    rows, frame = lives
    accepted, want = lived([r for r in rows if r[3] <= 15_000], 100), {}
    for i, job, _, s in sorted(rows, key=lambda r: (r[3], r[0])):
        if i in accepted and s <= 15_000:
            want[job] = (i, s)
    got = {r["scan_id"]: r["event_id"] for r in windows.job_latest_alive(frame, F.timestamp_seconds(F.lit(15_000)), seconds=100).collect()}
    assert got == {job: i for job, (i, s) in want.items() if 15_000 - s < 100}


def test_scans_of_nothing(spark):
    none = spark.createDataFrame([], "event_id long, scan_id string, status string, updated_at timestamp, url string")
    assert windows.job_states(none).collect() == [] and windows.job_expiry(none).collect() == []
    assert windows.rate_limit(none, client="scan_id", ts="updated_at", order=["event_id"]).collect() == []


def stream_of(spark, df, path, parts=3, order=("ts", "event_id"), end=None):
    """Write ``df`` as ordered files and read them one file per batch; ``end`` is a last row that moves the watermark."""
    ordered = df.orderBy(*order).collect()
    size = -(-len(ordered) // parts)
    files = [ordered[i * size:(i + 1) * size] for i in range(parts)] + ([[end]] if end else [])
    for rows in files:
        spark.createDataFrame(rows, df.schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def run(stream, name, mode="append"):
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).start()
    query.processAllAvailable()
    query.stop()


@pytest.fixture(scope="module")
def requests(spark, folder):
    return t.scan_requests(spark, folder).select("event_id", "client", "ts", "url").cache()


END = (-1, "the end", dt.datetime(2030, 1, 1), "http://end.example")


@pytest.mark.parametrize("order", [("ts", "event_id"), ("shuffled",)])
def test_rate_limit_stream_equals_batch(spark, requests, tmp_path, order):
    table = requests.withColumn("shuffled", F.md5(F.col("event_id").cast("string")))
    source = stream_of(spark, table, str(tmp_path), order=order, end=(*END, ""))
    name = f"limited_{len(order)}"
    run(limits.rate_limit_stream(source, limit=3, seconds=HOURS, watermark="60 days"), name)
    cols = ["event_id", "window_start_us", "position", "allowed", "remaining", "reset_after"]
    batch = windows.rate_limit(requests, order=["event_id"], limit=3, seconds=HOURS)
    assert sorted(map(tuple, spark.table(name).select(*cols).collect())) == sorted(map(tuple, batch.select(*cols).collect()))


def test_cache_stream_equals_batch(spark, requests, tmp_path):
    source = stream_of(spark, requests, str(tmp_path), end=END)
    run(limits.dedup_stream(source, seconds=HOURS), "fresh")
    batch = windows.ttl_cache_events(requests, order=["event_id"], seconds=HOURS).where("NOT cache_hit")
    assert {r["event_id"] for r in spark.table("fresh").collect()} == {r["event_id"] for r in batch.collect()}


def test_job_streams(spark, folder, tmp_path):
    changes = t.job_changes(spark, folder).withColumnRenamed("updated_at", "ts")
    source = stream_of(spark, changes, str(tmp_path)).withColumnRenamed("ts", "updated_at")
    run(jobs.job_latest_stream(source, order=["event_id"]), "jobs_now", "complete")
    want = windows.job_latest(t.job_changes(spark, folder), order=["event_id"])
    key = lambda df: {(r["scan_id"], r["status"], r["event_id"]) for r in df.collect()}
    assert key(spark.table("jobs_now")) == key(want)

    run(jobs.job_lifetimes_stream(source, seconds=HOURS), "lives")
    done = spark.table("lives").collect()
    assert done and all(r["expires_at"] - r["first_change"] >= dt.timedelta(seconds=HOURS) for r in done)
