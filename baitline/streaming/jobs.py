"""Job state and scoring on streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from baitline.functions.fixed_values import JOB_TTL_SECONDS, RESULT_TTL_SECONDS
from baitline.functions.hashing import intel_key
from baitline.operators.history import history_rows
from baitline.operators.intel import COMPLETED, COUNTED, DEADLINE_SECONDS, seen_columns
from baitline.operators.scanning import Scorer, no_models, scan
from baitline.operators.windows import job_latest
from baitline.sources.corpus import append_scan_batch

WATERMARK = "10 minutes"


def job_latest_stream(changes: DataFrame, scan_id: str = "scan_id", at: str = "updated_at", order: list[str] | None = None) -> DataFrame:
    """Running latest state per job (write with update or complete mode)."""
    return job_latest(changes, scan_id, at, order)


def job_lifetimes_stream(
    changes: DataFrame, scan_id: str = "scan_id", at: str = "updated_at", seconds: int = JOB_TTL_SECONDS, watermark: str = WATERMARK
) -> DataFrame:
    """Finished lifetimes: changes closer together than the lifetime form one session."""
    session = F.session_window(at, f"{seconds} seconds")
    return changes.withWatermark(at, watermark).groupBy(scan_id, session.alias("life")).agg(
        F.count(F.lit(1)).alias("n_changes")
    ).select(scan_id, F.col("life.start").alias("first_change"), F.col("life.end").alias("expires_at"), "n_changes")


def reports_seen_stream(
    scans: DataFrame, updates: DataFrame, scan_col: str = "event_id", url_col: str = "url", ts: str = "ts", at: str = "at", id_col: str = "update_id",
    deadline: float = DEADLINE_SECONDS, lifetime: float = RESULT_TTL_SECONDS, wanted: Column | None = None, watermark: str = WATERMARK,
    update_url_col: str = "url",
) -> DataFrame:
    """The stream of :func:`baitline.operators.intel.reports_seen` (write in append mode).

    A scan leaves once the watermark says that no update it could see is still to come,
    with the same columns as in batch. ``scan_col`` tells scans apart. Updates and scans of a URL meet
    within lifetime and deadline only, and both sides' state is dropped beyond them. The time column must be a timestamp;
    scans without a time or id have no place in a stream and are left out.
    """
    own = list(scans.columns)
    asked = F.lit(True) if wanted is None else F.coalesce(wanted, F.lit(False))
    left = scans.where(F.col(ts).isNotNull() & F.col(scan_col).isNotNull()).withWatermark(ts, watermark).select(
        F.struct(*own).alias("_row"), F.col(ts).alias("_ts"), F.col(scan_col).alias("_scan"), asked.alias("_asked"),
        F.when(asked, intel_key(F.col(url_col))).alias("_of"),
    )
    right = updates.where(F.col(at).isNotNull() & F.col(id_col).isNotNull() & F.col(update_url_col).isNotNull()).withWatermark(at, watermark).select(
        F.col(at).alias("_at"), intel_key(F.col(update_url_col)).alias("_key"),
        F.struct(
            F.coalesce((F.col("state") == COMPLETED).cast("int"), F.lit(0)).alias("done"), F.unix_micros(at).alias("us"),
            F.col(id_col).cast("long").alias("id"), "state", *[F.col(c).cast("int").alias(c) for c in COUNTED],
        ).alias("_update"),
    )
    reach = F.expr(f"_at > _ts - INTERVAL {lifetime} SECONDS AND _at <= _ts + INTERVAL {deadline} SECONDS")
    met = left.join(right, (F.col("_of") == F.col("_key")) & reach, "leftOuter")
    # one row for each scan: the last completed update, else the last
    best = met.groupBy("_ts", "_scan").agg(F.first("_row").alias("_row"), F.first("_asked").alias("_asked"), F.max("_update").alias("_update"))
    made = seen_columns(F.col("_update.state"), F.col("_asked"), "_update.")
    return best.select("_row.*", F.col("_update.id").alias("intel_seen_id"), *[c.alias(n) for n, c in made.items()])


def score_stream(
    urls: DataFrame, history_path: str, quarantine_path: str, checkpoint: str, scorer: Scorer = no_models,
    reports: DataFrame | None = None, id_col: str = "event_id", ts_col: str = "ts", **options,
) -> DataStreamWriter:
    """Writer that scans each micro-batch and appends history and quarantine rows.

    Each batch writes to a folder of its own number, so a replay after a failure
    replaces its output instead of doubling it. The batch is stored while both outputs
    are written, so the source is read once. ``lookup`` in ``options`` goes to the scan, as for rows of
    :func:`reports_seen_stream`, which bring their reports along.
    """
    def handle(batch: DataFrame, batch_id: int) -> None:
        held = batch.persist()
        try:
            good, bad = scan(held, scorer, reports, **options)
            append_scan_batch(history_rows(good, id_col, ts_col), batch_id, history_path)
            append_scan_batch(bad, batch_id, quarantine_path)
        finally:
            held.unpersist()

    return urls.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
