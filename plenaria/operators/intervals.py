"""Continuous periods of overlapping intervals, and the gaps between them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plenaria.operators.scan import carry_scan, range_sorted

#: Day number of an open end: after any day that can be written.
OPEN = 4_000_000


def _islands(batch: pd.DataFrame, keys: list[str], state: tuple | None) -> tuple[pd.DataFrame, tuple]:
    """Periods and gaps of one sorted batch, and the state after it.

    ``state``: keys, start and last day of the open period. Periods come out as far
    as the batch knows them; gaps are final.
    """
    s, e = batch["_s"].to_numpy(np.int64), batch["_e"].to_numpy(np.int64)
    named = batch[keys].to_numpy(dtype=object)
    new_key = np.ones(len(s), dtype=bool)
    new_key[1:] = (named[1:] != named[:-1]).any(axis=1)
    goes_on = state is not None and tuple(named[0]) == state[0]
    if goes_on:
        new_key[0] = False
    base = np.cumsum(new_key) * (2 * OPEN)
    shifted = e + base
    if goes_on:
        shifted[0] = max(shifted[0], state[2] + base[0])
    reach = np.maximum.accumulate(shifted) - base
    before = np.empty_like(reach)
    before[1:] = reach[:-1]
    before[0] = state[2] if goes_on else 0
    new_island = new_key | (s > before + 1)
    first = np.flatnonzero(new_island)
    heads = first if first.size and first[0] == 0 else np.concatenate(([0], first))
    starts = s[heads].copy()
    if not new_island[0]:
        starts[0] = state[1]
    tails = np.append(heads[1:], len(s)) - 1
    gaps = np.flatnonzero(new_island & ~new_key)
    where = np.concatenate((heads, gaps))
    out = pd.DataFrame({k: named[where, i] for i, k in enumerate(keys)})
    out["result_kind"] = ["period"] * len(heads) + ["gap"] * len(gaps)
    out["_s"] = np.concatenate((starts, before[gaps] + 1))
    out["_e"] = np.concatenate((reach[tails], s[gaps] - 1))
    return out, (tuple(named[-1]), int(starts[-1]), int(reach[-1]))


def periods_and_gaps(df: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """``keys``, ``result_kind``, ``start_date``, ``end_date`` (dates; null: open).

    ``df`` holds closed intervals of days, ``end`` null for an open one. Intervals
    that overlap, nest or touch (the next starts the day after) form one period; a
    gap is what lies between two successive periods of the same keys.

    Rows with a null key or start are left out, as are those that end before they
    start. Repeated rows change nothing; an empty input gives an empty result.

    Method: one range sort by keys and start over all partitions; a first pass
    keeps each partition's last open period, prefixes of those are combined, and a
    second pass labels periods with the carried state. A key of any size is
    spread over as many partitions as it fills.
    """
    number = [F.datediff(F.col(c), F.lit("1970-01-01").cast("date")) for c in (start, end)]
    days = df.select(*keys, number[0].alias("_s"), F.coalesce(number[1], F.lit(OPEN)).alias("_e"))
    known = days.where(" and ".join(f"`{k}` is not null" for k in keys) + " and _s is not null and _s <= _e")
    longest = known.groupBy(*keys, "_s").agg(F.max("_e").alias("_e"))
    types = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    renamed = [f"_first_{i}" for i in range(len(keys))], [f"_last_{i}" for i in range(len(keys))]
    kinds = [df.schema[k].dataType.simpleString() for k in keys]

    def summarise(batches: Iterator[pd.DataFrame]) -> dict | None:
        head, state = None, None
        for batch in batches:
            head = tuple(batch[keys].iloc[0]) if head is None else head
            _, state = _islands(batch, keys, state)
        if state is None:
            return None
        return {**dict(zip(renamed[0], head)), **dict(zip(renamed[1], state[0])), "_start": state[1], "_reach": state[2]}

    def combine(state: tuple | None, found: dict) -> tuple:
        head, last = (tuple(found[c] for c in cs) for cs in renamed)
        start_day, reach = found["_start"], found["_reach"]
        if state is not None and head == last == state[0]:  # one key fills the partition
            start_day = state[1] if start_day <= state[2] + 1 else start_day
            reach = max(reach, state[2])
        return last, start_day, reach

    def rescan(batches: Iterator[pd.DataFrame], state: tuple | None) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out, state = _islands(batch, keys, state)
            yield out

    fields = ", ".join(f"{c} {k}" for cs in renamed for c, k in zip(cs, kinds))
    ordered = range_sorted(longest, [*keys, "_s"])
    pieces = carry_scan(ordered, summarise, f"{fields}, _start bigint, _reach bigint", combine, rescan, f"{types}, result_kind string, _s int, _e int")
    whole = pieces.groupBy(*keys, "result_kind", "_s").agg(F.max("_e").alias("_e"))
    epoch = F.lit("1970-01-01").cast("date")
    last_day = F.when(F.col("_e") < OPEN, F.date_add(epoch, F.col("_e")))
    return whole.select(*keys, "result_kind", F.date_add(epoch, F.col("_s")).alias("start_date"), last_day.alias("end_date"))
