"""Anchored windows: rate limits, result reuse and job state.

An anchored window opens at the first event of a key that no earlier window of that
key covers, and lasts a fixed time. The next window opens at the first event at or
after its end, so windows are not aligned to the clock and depend on each other in
sequence.

All of them are ordered scans with a small carried state (see ``carry``): the open window,
or a job's last change. Rows are cut into chunks by (key, time), which any key may span,
so one route serves rare and hot keys alike.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from baitline.functions.fixed_values import (
    JOB_TTL_SECONDS,
    RATE_LIMIT,
    RATE_WINDOW_SECONDS,
    RESULT_TTL_SECONDS,
)
from baitline.functions.shipping import ship_with_tasks
from baitline.operators.carry import Machine, carried_scan

ship_with_tasks(__name__)

SECOND = 1_000_000
UNKNOWN_CLIENT = "unknown"


def micros(ts: str) -> Column:
    """Timestamp column as microseconds since the epoch."""
    return F.unix_micros(F.col(ts).cast("timestamp"))


def advance(times: np.ndarray, start: int | None, seen: int, width: int):
    """Window start and position for sorted times, continuing an open window."""
    starts, positions = np.empty(len(times), "int64"), np.empty(len(times), "int64")
    i = 0
    while i < len(times):
        if start is None or times[i] >= start + width:
            start, seen = int(times[i]), 0
        j = i + int(np.searchsorted(times[i:], start + width, side="left"))
        starts[i:j] = start
        positions[i:j] = np.arange(seen + 1, seen + 1 + j - i)
        seen += j - i
        i = j
    return starts, positions, start, seen


def _window_machine(width: int) -> Machine:
    def machine(columns, state):
        starts, positions, start, seen = advance(columns["at_us"], *(state or (None, 0)), width)
        return {"window_start_us": starts, "position": positions}, [start, seen]

    return machine


def named_key(key: str) -> Column:
    """A key as text that is never null: a null key is a key of its own."""
    return F.when(F.col(key).isNull(), F.lit("n")).otherwise(F.concat(F.lit("k"), F.col(key).cast("string")))


def lookup_window(
    events: DataFrame, starts: DataFrame, key: str, at: str, start: str, width: int, how: str, salts: int = 1
) -> DataFrame:
    """Give each event the non-overlapping window of its key that covers it.

    A window touches at most two grid cells of its own width, so the interval join is
    an equi-join on (key, cell). With ``salts`` above 1 the starts are replicated and
    the events of one cell spread over that many join groups; otherwise adaptive
    execution splits a skewed cell.
    """
    grid = lambda t: F.floor(t / width)
    placed = (
        starts.select(F.col(key).alias("_key"), F.col(start).alias("window_start_us"))
        .withColumn("_cell", F.explode(F.array(grid(F.col("window_start_us")), grid(F.col("window_start_us")) + 1)))
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    )
    salted = events.withColumns({
        "_event_cell": grid(F.col(at)),
        "_event_salt": F.pmod(F.xxhash64(*[F.col(c) for c in events.columns]), F.lit(salts)).cast("int"),
    })
    match = (
        (F.col(key) == F.col("_key")) & (F.col("_event_cell") == F.col("_cell")) & (F.col("_event_salt") == F.col("_salt"))
        & (F.col(at) >= F.col("window_start_us")) & (F.col(at) < F.col("window_start_us") + width)
    )
    return salted.join(placed, match, how).drop("_key", "_cell", "_salt", "_event_cell", "_event_salt")


def anchored_windows(
    df: DataFrame, key: str, ts: str, seconds: float, order: list[str], chunks: int | None = None
) -> DataFrame:
    """Append ``at_us``, ``window_start_us`` and ``position`` (1 opens the window).

    ``order`` breaks ties between events of one timestamp and should make rows unique.
    Events without a time belong to no window and are left out. Times before 1970 are not
    supported.
    """
    timed = df.withColumns({"at_us": micros(ts), "_named": named_key(key)}).where("at_us IS NOT NULL")
    machine = _window_machine(int(seconds * SECOND))
    return carried_scan(timed, "_named", ["at_us", *order], machine, ["at_us"], ["window_start_us", "position"], chunks).drop("_named")


def rate_limit(
    df: DataFrame, client: str = "client", ts: str = "ts", order: list[str] | None = None,
    limit: int = RATE_LIMIT, seconds: float = RATE_WINDOW_SECONDS, chunks: int | None = None,
) -> DataFrame:
    """Append ``allowed``, ``remaining`` and ``reset_after`` (seconds) per request.

    Denied requests count too. A missing client is rated as ``unknown``.
    """
    text = F.col(client).cast("string")
    named = df.withColumn(client, F.when(text.isNull() | (text == ""), F.lit(UNKNOWN_CLIENT)).otherwise(text))
    placed = anchored_windows(named, client, ts, seconds, order or [], chunks)
    left = F.col("window_start_us") + int(seconds * SECOND) - F.col("at_us")
    return placed.withColumns({
        "allowed": F.col("position") <= limit,
        "remaining": F.greatest(F.lit(limit) - F.col("position"), F.lit(0)),
        "reset_after": F.ceil(left / SECOND),
    })


def ttl_cache_events(
    df: DataFrame, url: str = "url", ts: str = "ts", order: list[str] | None = None,
    seconds: float = RESULT_TTL_SECONDS, chunks: int | None = None,
) -> DataFrame:
    """Append ``cache_hit`` and the life of the stored result in microseconds.

    A miss stores a result at its own time; hits do not extend it.
    """
    placed = anchored_windows(df, url, ts, seconds, order or [], chunks)
    return placed.withColumns({
        "cache_hit": F.col("position") > 1,
        "cached_from_us": F.col("window_start_us"),
        "cached_until_us": F.col("window_start_us") + int(seconds * SECOND),
    })


def stored_results(cache_events: DataFrame, url: str = "url") -> DataFrame:
    """The misses of a cache run: one stored result per row."""
    return cache_events.where(~F.col("cache_hit")).select(url, "cached_from_us", "cached_until_us")


def cache_lookup(
    requests: DataFrame, stored: DataFrame, url: str = "url", ts: str = "ts", seconds: float = RESULT_TTL_SECONDS
) -> DataFrame:
    """Append ``cache_hit`` and ``cached_from_us`` against a table of stored results.

    Stored results of one URL must not overlap (each lives ``seconds``).
    """
    timed = requests.withColumn("at_us", micros(ts))
    found = lookup_window(timed, stored, url, "at_us", "cached_from_us", int(seconds * SECOND), "left")
    return found.withColumn("cache_hit", F.col("window_start_us").isNotNull()).withColumnRenamed(
        "window_start_us", "cached_from_us"
    )


def job_latest(changes: DataFrame, scan_id: str = "scan_id", at: str = "updated_at", order: list[str] | None = None) -> DataFrame:
    """Latest state per job; changes of a job that was never queued are ignored.

    One aggregation with map-side combining; no per-job sort.
    """
    others = [c for c in changes.columns if c != scan_id]
    rank = F.struct(F.col(at), *[F.col(c) for c in order or []])
    queued_at = F.min(F.when(F.col("status") == "queued", rank))
    latest = changes.groupBy(scan_id).agg(
        F.max_by(F.struct(*others), rank).alias("_row"),
        queued_at.alias("_queued"), F.max(rank).alias("_last"),
        F.min(F.when(F.col("status") == "queued", F.col(at))).alias("created_at"),
    )
    return latest.where(F.col("_queued").isNotNull() & (F.col("_queued") <= F.col("_last"))).select(
        scan_id, "_row.*", "created_at"
    )


def _life_machine(ttl: int) -> Machine:
    """Lives of a job: reads ``at_us``, ``_what`` (0 a change, 1 one that queues, 2 a poll) and ``_id``.

    Changes closer than the lifetime to the change before belong together, accepted or
    not; in each such session those from the first queueing on are accepted. The state is
    the last change's time, the time its job was queued (-1: not accepted) and its id.
    """
    def machine(columns, state):
        at, what, ids = columns["at_us"], columns["_what"], columns["_id"]
        change = np.flatnonzero(what < 2)
        times = at[change]
        n, index = len(change), np.arange(len(change))
        before = np.concatenate([[state[0] if state else -1], times[:-1]]) if n else times
        fresh = (before < 0) | (times - before >= ttl)
        session = np.maximum.accumulate(np.where(fresh, index, -1)) if n else index
        queued = np.maximum.accumulate(np.where(what[change] == 1, index, -1)) if n else index
        created = np.where((queued >= 0) & (queued >= session), times[np.maximum(queued, 0)], -1) if n else times
        # what came before goes on until the first fresh change
        created = np.where((session < 0) & (queued < 0), state[1] if state else -1, created)
        gap = np.where(before < 0, -1, times - before)
        out = {c: np.full(len(at), -1, dtype=np.int64) for c in ("gap_us", "created_us", "seen_id", "seen_us")}
        out["gap_us"][change], out["created_us"][change] = gap, created
        poll = np.flatnonzero(what == 2)
        if len(poll):
            known = np.concatenate([[state or [-1, -1, -1]], np.stack([times, created, ids[change]], axis=1)]).astype(np.int64)
            last = known[np.searchsorted(change, poll)]
            alive = (last[:, 1] >= 0) & (at[poll] - last[:, 0] < ttl)
            out["seen_us"][poll], out["seen_id"][poll] = np.where(alive, last[:, 0], -1), np.where(alive, last[:, 2], -1)
        return out, [int(times[-1]), int(created[-1]), int(ids[change[-1]])] if n else state or [-1, -1, -1]

    return machine


_LIFE = ["gap_us", "created_us", "seen_id", "seen_us"]


def _lived(rows: DataFrame, seconds: float, chunks: int | None) -> DataFrame:
    return carried_scan(rows, "_named", ["at_us", "_id"], _life_machine(int(seconds * SECOND)), ["at_us", "_what", "_id"], _LIFE, chunks)


def job_states(
    changes: DataFrame, scan_id: str = "scan_id", at: str = "updated_at", id_col: str = "event_id", seconds: float = JOB_TTL_SECONDS,
    chunks: int | None = None,
) -> DataFrame:
    """Every change with ``accepted``, ``created_at_us`` (when its job was queued last) and ``expires_at_us``.

    Queueing makes a job; every change renews its lifetime. A change of a job that was never
    queued, or has expired (the lifetime has passed since its last change), does nothing.
    Changes of one time are taken in the order of ``id_col``, whole numbers of zero or more that tell changes
    apart. Changes without a time or job are left out.
    """
    rows = changes.withColumns({
        "at_us": micros(at), "_named": named_key(scan_id), "_id": F.col(id_col).cast("long"),
        "_what": F.coalesce((F.col("status") == "queued").cast("int"), F.lit(0)),
    }).where(F.col("at_us").isNotNull() & F.col(scan_id).isNotNull() & F.col("_id").isNotNull())
    lived = _lived(rows, seconds, chunks)
    accepted = F.col("created_us").isNotNull()
    return lived.withColumns({
        "accepted": accepted, "created_at_us": F.col("created_us"),
        "expires_at_us": F.when(accepted, F.col("at_us") + int(seconds * SECOND)),
    }).drop("_named", "_what", "_id", *_LIFE)


def job_latest_alive(
    changes: DataFrame, as_of: Column, scan_id: str = "scan_id", at: str = "updated_at", id_col: str = "event_id", seconds: float = JOB_TTL_SECONDS,
) -> DataFrame:
    """The last accepted change of each job up to ``as_of``, where that job has not expired by then."""
    until = F.unix_micros(as_of.cast("timestamp"))
    taken = job_states(changes.where(F.col(at).cast("timestamp") <= as_of.cast("timestamp")), scan_id, at, id_col, seconds).where("accepted")
    last = taken.groupBy(scan_id).agg(F.max(F.struct("at_us", F.col(id_col).alias("_last"))).alias("_at"))
    last = last.where(F.col("_at.at_us") + int(seconds * SECOND) > until).select(F.col(scan_id).alias("_of"), "_at._last")
    return taken.join(last, (F.col(scan_id) == F.col("_of")) & (F.col(id_col) == F.col("_last"))).drop("_of", "_last", "accepted")


def job_seen_at(
    polls: DataFrame, changes: DataFrame, scan_id: str = "scan_id", polled_at: str = "polled_at", at: str = "updated_at",
    id_col: str = "event_id", seconds: float = JOB_TTL_SECONDS, chunks: int | None = None,
) -> DataFrame:
    """As-of join: polls with ``seen_id`` and ``seen_us``, the last accepted change at or before the poll that is still alive then.

    Polls and changes are scanned together in order, so no pair of them is formed and no
    job's rows are gathered. Both columns are null where there is no such change, and for
    polls without a job or time.
    """
    named = lambda df, ts, what, own: df.select(
        named_key(scan_id).alias("_named"), micros(ts).alias("at_us"), what.alias("_what"), own.alias("_id"),
    )
    able = F.col(scan_id).isNotNull() & F.col(polled_at).isNotNull()
    numbered = polls.where(able).select(scan_id, polled_at).distinct()
    asked = named(numbered, polled_at, F.lit(2), F.lit(0).cast("long"))
    given = changes.where(F.col(scan_id).isNotNull() & F.col(at).isNotNull() & F.col(id_col).isNotNull())
    made = named(given, at, F.coalesce((F.col("status") == "queued").cast("int"), F.lit(0)), F.col(id_col).cast("long"))
    # the order puts a change of the poll's own time first, whatever it does
    rows = asked.unionByName(made).withColumn("_poll", (F.col("_what") == 2).cast("int"))
    lived = carried_scan(
        rows, "_named", ["at_us", "_poll", "_id"], _life_machine(int(seconds * SECOND)), ["at_us", "_what", "_id"], _LIFE, chunks,
    )
    answers = lived.where("_what = 2").select(F.col("_named").alias("_of"), F.col("at_us").alias("_at"), "seen_id", "seen_us")
    return polls.withColumns({"_named": named_key(scan_id), "_us": micros(polled_at)}).join(
        answers, (F.col("_named") == F.col("_of")) & (F.col("_us") == F.col("_at")), "left",
    ).drop("_named", "_us", "_of", "_at")


def job_expiry(
    changes: DataFrame, scan_id: str = "scan_id", at: str = "updated_at", seconds: float = JOB_TTL_SECONDS, chunks: int | None = None
) -> DataFrame:
    """Distinct change times per job with the gap before each, and ``expired_before``.

    Every change renews the lifetime, so a job had expired when the gap reaches it.
    """
    times = changes.select(scan_id, micros(at).alias("at_us")).where("at_us IS NOT NULL").distinct()
    rows = times.withColumns({"_named": named_key(scan_id), "_what": F.lit(0), "_id": F.lit(0).cast("long")})
    return _lived(rows, seconds, chunks).select(
        scan_id, "at_us", "gap_us", F.coalesce(F.col("gap_us") >= int(seconds * SECOND), F.lit(False)).alias("expired_before")
    )
