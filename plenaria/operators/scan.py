"""Scans in a global order whose state crosses partitions.

Rows are range-sorted once and written to the checkpoint folder. A first pass
sends one summary for each partition to the driver (as many as partitions, not
rows), their prefixes are combined there, and a second pass starts every
partition with the state that the ones before it leave. No group, however large,
has to fit one task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plenaria.session import checkpoint, shuffle_partitions

PART = "_part"


def range_sorted(df: DataFrame, order: list[str]) -> DataFrame:
    """``df`` sorted by ``order`` over all partitions, with the partition's number in ``_part``."""
    placed = df.repartitionByRange(shuffle_partitions(df.sparkSession), *order).sortWithinPartitions(*order)
    return checkpoint(placed.withColumn(PART, F.spark_partition_id()))


def carry_scan(
    ordered: DataFrame,
    summarise: Callable[[Iterator[pd.DataFrame]], dict[str, Any] | None],
    summary_schema: str,
    combine: Callable[[Any, dict[str, Any]], Any],
    rescan: Callable[[Iterator[pd.DataFrame], Any], Iterator[pd.DataFrame]],
    schema: str,
) -> DataFrame:
    """Scan the result of :func:`range_sorted` with carried state.

    ``summarise`` turns a partition into one summary (None if it is empty),
    ``combine(state, summary)`` gives the state after a partition, and ``rescan``
    gets a partition with the state before it (None at the very start).
    """

    def summaries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part: list[int] = []

        def noted() -> Iterator[pd.DataFrame]:
            for batch in batches:
                if len(batch):
                    part[:] = [int(batch[PART].iloc[0])]
                    yield batch

        if (found := summarise(noted())) is not None:
            yield pd.DataFrame([{PART: part[0], **found}])

    rows = ordered.mapInPandas(summaries, f"{PART} int, {summary_schema}").collect()
    carried, state = {}, None
    for row in sorted(rows, key=lambda r: r[PART]):
        carried[row[PART]] = state
        state = combine(state, row.asDict())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        full = (b for b in batches if len(b))
        if (head := next(full, None)) is None:
            return

        def again() -> Iterator[pd.DataFrame]:
            yield head
            yield from full

        yield from rescan(again(), carried.get(int(head[PART].iloc[0])))

    return ordered.mapInPandas(run, schema)


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """``df`` with the place of each row in ``order`` over all partitions, from 1; only counts of partitions go to the driver."""
    ordered = range_sorted(df, order)
    counted = ordered.groupBy(PART).count().collect()
    before, total = {}, 0
    for part, n in sorted(counted):
        before[part] = total
        total += n

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at = None
        for batch in batches:
            if len(batch):
                at = before[int(batch[PART].iloc[0])] if at is None else at
                yield batch.drop(columns=PART).assign(**{name: range(at + 1, at + 1 + len(batch))})
                at += len(batch)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return ordered.mapInPandas(run, f"{fields}, `{name}` bigint")
