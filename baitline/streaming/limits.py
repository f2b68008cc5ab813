"""Rate limits and result reuse on streams: anchored windows with keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from baitline.functions.fixed_values import RATE_LIMIT, RATE_WINDOW_SECONDS, RESULT_TTL_SECONDS
from baitline.functions.shipping import ship_with_tasks
from baitline.operators.windows import SECOND, UNKNOWN_CLIENT, advance, micros

ship_with_tasks(__name__)

WATERMARK = "10 minutes"


def anchored_stream(events: DataFrame, key: str, ts: str, order: str, seconds: float, watermark: str = WATERMARK) -> DataFrame:
    """Streaming ``anchored_windows``: key, order, at_us, window_start_us, position.

    Rows may come in any order within the watermark: they wait in the key's state until
    the watermark has passed them, so no earlier row can follow, and are then placed in
    order. State per key is the open window (start, count) and the waiting rows; it is
    dropped when nothing waits and the window has lapsed. Rows older than the watermark
    are dropped by Spark. Only three narrow columns reach Python. A row is emitted once
    the stream's time is a watermark past it.
    """
    width = int(seconds * SECOND)
    key_type, order_type = events.schema[key].dataType.simpleString(), events.schema[order].dataType.simpleString()

    def step(group: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        start, seen, held_at, held_tie = state.get if state.exists else (None, 0, [], [])
        held = pd.DataFrame({"at_us": pd.Series(held_at, dtype="int64"), "tie": held_tie})
        new = [c[["at_us", "tie"]] for c in chunks if len(c)]
        rows = pd.concat([held, *new] if len(held) or not new else new, ignore_index=True).sort_values(["at_us", "tie"], kind="stable")
        passed = state.getCurrentWatermarkMs()
        ready, wait = rows[rows["at_us"] <= passed * 1000], rows[rows["at_us"] > passed * 1000]
        starts, positions, start, seen = advance(ready["at_us"].to_numpy(), start, seen, width)
        if not len(wait) and (start is None or start + width <= passed * 1000):
            state.remove()
        else:
            state.update((start, seen, wait["at_us"].tolist(), wait["tie"].tolist()))
            due = int(wait["at_us"].iloc[0]) if len(wait) else start + width
            state.setTimeoutTimestamp(max(due // 1000 + 1, passed + 1))
        if len(ready):
            yield pd.DataFrame({
                key: group[0], order: ready["tie"].to_numpy(), "at_us": ready["at_us"].to_numpy(),
                "window_start_us": starts, "position": positions,
            })

    narrow = events.withWatermark(ts, watermark).select(
        F.col(key), F.col(ts).alias("event_time"), micros(ts).alias("at_us"), F.col(order).alias("tie")
    )
    return narrow.groupBy(key).applyInPandasWithState(
        step,
        f"{key} {key_type}, {order} {order_type}, at_us long, window_start_us long, position long",
        f"start long, seen long, held_at array<long>, held_tie array<{order_type}>",
        "append",
        GroupStateTimeout.EventTimeTimeout,
    )


def rate_limit_stream(
    events: DataFrame, client: str = "client", ts: str = "ts", order: str = "event_id",
    limit: int = RATE_LIMIT, seconds: float = RATE_WINDOW_SECONDS, watermark: str = WATERMARK,
) -> DataFrame:
    text = F.col(client).cast("string")
    named = events.withColumn(client, F.when(text.isNull() | (text == ""), F.lit(UNKNOWN_CLIENT)).otherwise(text))
    placed = anchored_stream(named, client, ts, order, seconds, watermark)
    left = F.col("window_start_us") + int(seconds * SECOND) - F.col("at_us")
    return placed.withColumns({
        "allowed": F.col("position") <= limit,
        "remaining": F.greatest(F.lit(limit) - F.col("position"), F.lit(0)),
        "reset_after": F.ceil(left / SECOND),
    })


def ttl_cache_stream(
    requests: DataFrame, url: str = "url", ts: str = "ts", order: str = "event_id",
    seconds: float = RESULT_TTL_SECONDS, watermark: str = WATERMARK,
) -> DataFrame:
    """Which requests reuse a result; also the stream's de-duplication (misses are first asks)."""
    placed = anchored_stream(requests, url, ts, order, seconds, watermark)
    return placed.withColumns({
        "cache_hit": F.col("position") > 1,
        "cached_from_us": F.col("window_start_us"),
        "cached_until_us": F.col("window_start_us") + int(seconds * SECOND),
    })


def dedup_stream(requests: DataFrame, url: str = "url", ts: str = "ts", order: str = "event_id",
                 seconds: float = RESULT_TTL_SECONDS, watermark: str = WATERMARK) -> DataFrame:
    """Requests that need a fresh scan: repeats inside the life of a result are dropped."""
    return ttl_cache_stream(requests, url, ts, order, seconds, watermark).where(~F.col("cache_hit"))
