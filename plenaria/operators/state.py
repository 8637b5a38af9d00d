"""Counters and windows over an event log, as batch operators.

The same folds run on streams in :mod:`plenaria.streaming.windows`.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plenaria.session import shuffle_partitions


def by_key_in_order(df: DataFrame, key: str | list[str], order: list[str]) -> DataFrame:
    """Rows of a key together and in order, so that a fold streams over them without holding a group."""
    keys = [key] if isinstance(key, str) else key
    return df.repartition(shuffle_partitions(df.sparkSession), *keys).sortWithinPartitions(*keys, *order)


def anchored_windows(df: DataFrame, key: str, at: str, tie: str, seconds: int) -> DataFrame:
    """``key``, ``window_start``, ``hits``: windows that a key's first hit opens, ``seconds`` long.

    The first hit at or after the end opens the next one, so windows follow no grid.
    Rows without key or time count for nothing.
    """
    own = df.where(F.col(key).isNotNull() & F.col(at).isNotNull()).select(key, F.unix_micros(F.col(at).cast("timestamp")).alias("_t"), F.col(tie).alias("_i"))
    span = seconds * 1_000_000

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        who, start, hits = None, 0, 0
        for batch in batches:
            out = []
            for k, t in zip(batch[key].tolist(), batch["_t"].tolist()):
                if k == who and t - start < span:
                    hits += 1
                    continue
                if who is not None:
                    out.append((who, start, hits))
                who, start, hits = k, t, 1
            yield pd.DataFrame(out, columns=[key, "_t", "hits"])
        if who is not None:
            yield pd.DataFrame([(who, start, hits)], columns=[key, "_t", "hits"])

    kind = df.schema[key].dataType.simpleString()
    found = by_key_in_order(own, key, ["_t", "_i"]).mapInPandas(run, f"`{key}` {kind}, _t bigint, hits bigint")
    return found.select(key, F.timestamp_micros("_t").cast(df.schema[at].dataType).alias("window_start"), "hits")


def counted_once(df: DataFrame, key: str, group: str, view: str, at: str, tie: str, seconds: int = 30, most: int = 4) -> DataFrame:
    """Rows with ``counted``: whether a view costs its key one.

    A view that its key has seen is free. The first new view of a group is counted
    and lets up to ``most`` views of that group in for ``seconds``; a group that has
    run out stays as it was and opens no second window. Groups of one key are independent once
    repeated views are set apart, so a key's rows are spread by group and no task remembers views.
    """
    own = df.where(F.col(key).isNotNull() & F.col(at).isNotNull()).withColumn("_t", F.unix_micros(F.col(at).cast("timestamp")))
    span = seconds * 1_000_000
    place = F.row_number().over(Window.partitionBy(key, view).orderBy("_t", tie))
    placed = own.withColumn("_first", place == 1)  # a view seen before costs nothing and changes nothing

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        who, since, used = None, 0, 0
        for batch in batches:
            flags = []
            for k, g, t in zip(batch[key].tolist(), batch[group].tolist(), batch["_t"].tolist()):
                fresh = (k, g) != who
                if not fresh and t - since <= span and used < most:
                    used += 1
                    flags.append(0)
                    continue
                if fresh:
                    who, since, used = (k, g), t, 1
                flags.append(1)
            yield batch[fields].assign(counted=flags)

    fields = own.columns
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema.fields)
    firsts = by_key_in_order(placed.where("_first").drop("_first"), [key, group], ["_t", tie]).mapInPandas(run, f"{types}, counted int")
    return firsts.unionByName(placed.where("not _first").drop("_first").withColumn("counted", F.lit(0))).drop("_t")


def gap_filled(df: DataFrame, day: str, keys: list[str], days: int, last: Column, count: str = "count") -> DataFrame:
    """Counts by day over the ``days`` up to ``last`` for every key, zeros included."""
    counted = df.groupBy(*keys, day).agg(F.count(F.lit(1)).alias(count))
    span = F.sequence(F.date_sub(last, days - 1), last)
    every = df.select(*keys).distinct().select(*keys, F.explode(span).alias(day))
    return every.join(counted, [*keys, day], "left").withColumn(count, F.coalesce(count, F.lit(0)))


def after_cursor(df: DataFrame, cursors: DataFrame, key: str, at: str, cursor: str) -> DataFrame:
    """Rows later than their key's cursor (a key without one sees all)."""
    moved = cursors.groupBy(key).agg(F.max(cursor).alias("_c"))
    return df.join(moved, key, "left").where(F.col("_c").isNull() | (F.col(at) > F.col("_c"))).drop("_c")


def expired(at: str, now: Column, days: int) -> Column:
    """Whether a row is past its keeping time."""
    return F.col(at) < now - F.make_dt_interval(F.lit(days))
