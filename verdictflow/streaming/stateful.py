"""Per-event stateful operators on streams: window counters and token buckets.

State is keyed by what the batch operators partition by and kept by Spark's checkpoints (a restart goes on
counting). With a time to live it leaves by a processing-time timeout; such a query looks for timeouts for
ever, so one that is to drain (availableNow) has none. Events of a micro-batch are taken per key in the
order of (timestamp, event_id)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import epoch_of
from ..operators.evaluators import group_key


def running_counts(events: DataFrame, window_ms: int, group_by: str = "entity", tag: str = "", ttl_ms: int | None = None) -> DataFrame:
    """tenant_id, key, epoch, event_id, timestamp, window_count: one row an event."""

    def step(key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        # order within the batch needs all of the key's chunks: a key's share of one micro-batch
        rows = pd.concat(list(chunks)).sort_values(["timestamp", "event_id"], kind="stable")
        n = state.get[0] if state.exists else 0
        state.update((n + len(rows),))
        if ttl_ms is not None:
            state.setTimeoutDuration(ttl_ms)
        yield pd.DataFrame({"tenant_id": key[0], "key": key[1], "epoch": key[2], "event_id": rows["event_id"].to_numpy(), "timestamp": rows["timestamp"].to_numpy(), "window_count": range(n + 1, n + len(rows) + 1)})

    keyed = events.select("tenant_id", group_key(group_by, tag).alias("key"), epoch_of(F.col("timestamp"), window_ms).alias("epoch"), "event_id", "timestamp")
    return keyed.groupBy("tenant_id", "key", "epoch").applyInPandasWithState(step, "tenant_id string, key string, epoch long, event_id long, timestamp timestamp, window_count long", "n long", "append", GroupStateTimeout.NoTimeout if ttl_ms is None else GroupStateTimeout.ProcessingTimeTimeout)


def token_buckets(events: DataFrame, capacity: int, per_second: int = 0) -> DataFrame:
    """tenant_id, event_id, timestamp, admitted; per_second 0 never refills."""
    full = capacity * 1_000_000

    def step(key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(chunks)).sort_values(["timestamp", "event_id"], kind="stable")
        level, last = state.get if state.exists else (full, -1)
        out = []
        for us in (rows["timestamp"].astype("int64") // (1000 if str(rows["timestamp"].dtype).startswith("datetime64[ns") else 1)).tolist():
            if last >= 0 and us > last:
                level = min(full, level + (us - last) * per_second)
            last = max(last, us)
            out.append(level >= 1_000_000)
            level -= 1_000_000 * out[-1]
        state.update((level, last))
        yield pd.DataFrame({"tenant_id": key[0], "event_id": rows["event_id"].to_numpy(), "timestamp": rows["timestamp"].to_numpy(), "admitted": out})

    return events.select("tenant_id", "event_id", "timestamp").groupBy("tenant_id").applyInPandasWithState(step, "tenant_id string, event_id long, timestamp timestamp, admitted boolean", "level long, last long", "append", GroupStateTimeout.NoTimeout)
