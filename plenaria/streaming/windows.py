"""The stateful folds on Structured Streaming."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def anchored_windows(events: DataFrame, key: str, at: str, seconds: int, late: str = "1 minute") -> DataFrame:
    """``key``, ``window_start``, ``hits``: each window once, when the watermark passes its end.

    As :func:`plenaria.operators.state.anchored_windows`: a key's first hit opens a
    window of ``seconds``. A key's state is one window and the hits that wait for the
    watermark; hits later than ``late`` are dropped.
    """
    span = seconds * 1000
    kind = events.schema[key].dataType.simpleString()

    def fold(group: tuple[Any], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        waiting = list(state.get[0]) if state.exists else []
        for batch in batches:
            waiting.extend((batch["_t"]).tolist())
        waiting.sort()
        mark, out = state.getCurrentWatermarkMs(), []
        while waiting and waiting[0] + span <= mark:
            inside = [t for t in waiting if t < waiting[0] + span]
            out.append((group[0], waiting[0], len(inside)))
            waiting = waiting[len(inside) :]
        if waiting:
            state.update((waiting,))
            state.setTimeoutTimestamp(max(waiting[0] + span, mark + 1))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=[key, "_t", "hits"])

    timed = events.where(F.col(key).isNotNull()).withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    own = timed.select(key, at, F.unix_millis(at).alias("_t"))
    found = own.groupBy(key).applyInPandasWithState(fold, f"`{key}` {kind}, _t bigint, hits bigint", "waiting array<bigint>", "append", GroupStateTimeout.EventTimeTimeout)
    return found.select(key, F.timestamp_millis("_t").alias("window_start"), "hits")


def running_counters(events: DataFrame, keys: list[str]) -> DataFrame:
    """Counters of ``keys`` for update or complete mode: an upsert of count and last time."""
    return events.groupBy(*keys).agg(F.count(F.lit(1)).alias("hits"))


def daily_counts(events: DataFrame, at: str, keys: list[str], late: str = "1 day") -> DataFrame:
    """Events of ``keys`` in each day, final once the watermark has passed the day."""
    timed = events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    return timed.groupBy(F.window(at, "1 day"), *keys).agg(F.count(F.lit(1)).alias("events")).select(F.to_date("window.start").alias("day"), *keys, "events")
