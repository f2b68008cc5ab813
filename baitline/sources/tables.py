"""Binding of the engine's inputs to the tables of a data folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from baitline.functions.hashing import leading_bits, unit_interval
from baitline.session import spread


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def urls(spark: SparkSession, folder: str) -> DataFrame:
    """page_id, url."""
    return spread(read(spark, folder, "pages").select("page_id", "url"))


def md5_label(text: Column) -> Column:
    """A dense 0/1 label: parity of a hash."""
    return (leading_bits(F.md5(text)) % 2).cast("int")


def labelled_urls(spark: SparkSession, folder: str) -> DataFrame:
    """page_id, url, label (hash parity, as few pages are labelled)."""
    return urls(spark, folder).withColumn("label", md5_label(F.col("url")))


def page_labels(spark: SparkSession, folder: str) -> DataFrame:
    """page_id, url, label from the labels table (sparse)."""
    labels = read(spark, folder, "labels").select(F.col("doc_id").alias("page_id"), F.col("toxic").alias("label"))
    return urls(spark, folder).join(labels, "page_id")


def probe_variants() -> list[Column]:
    """URLs derived from a page so that every rule, feature and rejection occurs.

    Work on columns url, page_id and on ``host`` and ``tail`` cut from the URL text.
    """
    pid = F.col("page_id").cast("string")
    host, tail, digest = F.col("host"), F.col("tail"), F.md5("url")
    c = F.concat
    s = F.lit
    return [
        F.col("url"),
        c(s("http://user"), pid, s(":pw@"), host, s("/login"), tail),
        c(s("http://10."), (F.col("page_id") % 300).cast("string"), s(".3.7/account/verify?a=1&&b=2")),
        c(s("https://paypal-security."), host, s("/verify/account?login=1")),
        c(s("HTTPS://WWW."), F.upper(host), s(".:8443/Secure/%2Flogin%3Fa%20b#frag")),
        c(s("https://google-login."), pid, s(".example.xyz/a/b/c/d/e/f/g?a=1&b=2&c=3&d=4&e=5&f=6&g=7&h=8")),
        c(s("  accounts.google.com"), tail),
        c(s("https://a.b.c.d.e."), F.substring(digest, 1, 12), s(".co.uk/"), digest, s("-"), F.upper(digest), s("/"), digest,
          s("/"), digest, s("/"), digest, s("/"), digest),
        c(s("https://microsoft."), host, s(".top/0x1F/deadbeef99/signin?x=@1")),
        c(s("https://xn--"), host, s(":99999/recover/wallet")),
        c(s("not a valid url "), pid),
        s(""),
        c(s("https://"), host, s("/"), F.repeat(s("a"), 2050)),
        c(s("ftp://"), host, tail),
        c(s("https://"), host, s(":8080/ünï/login_confirm-update?q=é&sign-in=verify.")),
        c(s("https://"), F.repeat(s("sub-"), 20), host, s("/update%payment%now%")),
    ]


N_PROBES = 16


def probes(spark: SparkSession, folder: str) -> DataFrame:
    """page_id, page_url, variant, url: sixteen derived URLs per page."""
    after = F.substr(F.col("url"), F.instr("url", "://") + 3)
    cut = urls(spark, folder).withColumn("host", F.substring_index(after, "/", 1)).withColumn(
        "tail", F.substr(after, F.length("host") + 1)
    )
    variants = probe_variants()
    assert len(variants) == N_PROBES
    return cut.select(
        "page_id", F.col("url").alias("page_url"), F.posexplode(F.array(*variants)).alias("variant", "url")
    )


def page_count(spark: SparkSession, folder: str) -> int:
    return read(spark, folder, "pages").count()


def scan_requests(spark: SparkSession, folder: str) -> DataFrame:
    """event_id, client, ts, page_id, url: every event asks for one page."""
    n = page_count(spark, folder)
    events = read(spark, folder, "events").select(
        "event_id", F.col("user_id").cast("string").alias("client"), F.col("ts").cast("timestamp").alias("ts"),
        (F.col("event_id") % n).alias("page_id"),
    )
    return events.join(urls(spark, folder), "page_id")


def page_events(spark: SparkSession, folder: str) -> DataFrame:
    """Events with ``page_id`` and the page's ``url``: every event is about one page."""
    n = page_count(spark, folder)
    events = read(spark, folder, "events").withColumn("page_id", F.col("event_id") % n)
    return events.join(urls(spark, folder), "page_id")


def verdicts(spark: SparkSession, folder: str) -> DataFrame:
    """url, engine, verdict: events read as engine verdicts on pages, which differ in how harsh their engines are."""
    kind = F.col("page_id") % 4
    mapped = (
        F.when((F.col("event_type") == "error") & (kind == 0), "malicious")
        .when((F.col("event_type") == "click") & kind.isin(0, 1) & (F.col("value") > 40), "suspicious")
        .when(F.col("event_type") == "signup", "timeout")
        .when(F.col("event_type") == "view", "harmless")
        .otherwise("undetected")
    )
    return page_events(spark, folder).select("url", F.col("user_id").alias("engine"), mapped.alias("verdict"))


def analysis_state(event_type: Column) -> Column:
    """An event's type read as the state of a report's analysis."""
    return F.when(event_type == "error", "error").when(event_type == "signup", "queued").otherwise("completed")


def report_states(spark: SparkSession, folder: str) -> DataFrame:
    """url, state: how the analysis of a page stands after its last event."""
    last = F.max_by("event_type", "event_id")
    return page_events(spark, folder).groupBy("url").agg(analysis_state(last).alias("state"))


def report_updates(spark: SparkSession, folder: str) -> DataFrame:
    """update_id, url, at, state and verdict counts: two of three events read as news of a page's analysis."""
    tenths = F.floor(F.col("value") * 10).cast("int")
    return page_events(spark, folder).where("event_id % 3 <> 0").select(
        F.col("event_id").alias("update_id"), "url", F.col("ts").cast("timestamp").alias("at"),
        F.when(F.col("event_type") == "click", "in-progress").otherwise(analysis_state(F.col("event_type"))).alias("state"),
        (tenths % 4).alias("malicious"), (tenths % 3).alias("suspicious"), (tenths % 7).alias("harmless"), (tenths % 5).alias("undetected"),
    )


def pseudo_probability(url: Column, model: str) -> Column:
    """A reproducible stand-in for a model's probability."""
    return unit_interval(F.md5(F.concat(F.lit(model), url)))


def predictions(spark: SparkSession, folder: str) -> DataFrame:
    """page_id, url, label, probability (two decimals, so ties occur), prediction."""
    scored = labelled_urls(spark, folder).withColumn("probability", F.round(pseudo_probability(F.col("url"), "u"), 2))
    return scored.withColumn("prediction", (F.col("probability") > 0.5).cast("int"))


def job_changes(spark: SparkSession, folder: str) -> DataFrame:
    """event_id, scan_id, status, updated_at: events read as state changes of a job per user."""
    status = (
        F.when(F.col("event_type") == "signup", "queued")
        .when(F.col("event_type") == "view", "processing")
        .when(F.col("event_type") == "error", "failed")
        .otherwise("completed")
    )
    return read(spark, folder, "events").select(
        "event_id", F.concat(F.lit("job-"), F.col("user_id")).alias("scan_id"), status.alias("status"),
        F.col("ts").cast("timestamp").alias("updated_at"),
        F.concat(F.lit("u"), F.col("user_id")).alias("url"), F.col("value").alias("duration_ms"),
    )
