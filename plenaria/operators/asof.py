"""Attributes as they were known at the time of an event."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from plenaria.operators.intervals import OPEN
from plenaria.operators.skew import all_salts, hot_keys, salt
from plenaria.session import shuffle_partitions

#: Rows of the left side that one bucket should hold.
BUCKET_ROWS = 100_000
#: Days of a time slice: the histories of one entity are swept slice by slice.
SLICE = 365


def asof_left_join(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, values: list[str]) -> DataFrame:
    """Every row of ``left`` with ``values`` of the latest ``right`` row of its ``keys`` at or before its time.

    ``values`` are null where there is none (also for null keys or times). Rows of
    ``right`` must be unique by keys and time; a column of ``left`` wins no name
    that ``values`` has, so rename clashes before.

    Entities (``keys[0]``) are hash-partitioned into buckets of about
    ``BUCKET_ROWS`` rows, hot ones split further with their right rows repeated;
    within a bucket an embedded engine runs the ASOF LEFT JOIN on Arrow tables.
    """
    spark = left.sparkSession
    rows = left.count()
    buckets = max(shuffle_partitions(spark), math.ceil(rows / BUCKET_ROWS))
    hot = hot_keys(left, keys[0], rows)
    salts = shuffle_partitions(spark)
    spread = F.struct(*[F.col(c) for c in left.columns])
    bucket = F.pmod(F.xxhash64(F.col(keys[0]), F.col("_salt")), F.lit(buckets)).cast("int")
    own = left.withColumn("_salt", salt(keys[0], spread, hot, salts)).withColumn("_bucket", bucket).drop("_salt")
    other = all_salts(right.select(*keys, right_time, *values), keys[0], hot, salts).withColumn("_bucket", bucket).drop("_salt")
    schema = StructType([*left.schema.fields, *[right.schema[v] for v in values]])
    arrow = to_arrow_schema(schema)
    names = ", ".join(f'l."{c}"' for c in left.columns)
    taken = ", ".join(f'r."{v}"' for v in values)
    matched = " AND ".join(f'l."{k}" = r."{k}"' for k in keys)
    sql = f'SELECT {names}, {taken} FROM l ASOF LEFT JOIN r ON {matched} AND l."{left_time}" >= r."{right_time}"'

    def join(events: pa.Table, versions: pa.Table) -> pa.Table:
        import duckdb

        if events.num_rows == 0:
            return arrow.empty_table()
        engine = duckdb.connect(config={"threads": 1})
        try:
            engine.register("l", events)
            engine.register("r", versions)
            found = engine.sql(sql).to_arrow_table()
        finally:
            engine.close()
        return pa.table([found.column(i).cast(f.type) for i, f in enumerate(arrow)], schema=arrow)

    return own.groupBy("_bucket").cogroup(other.groupBy("_bucket")).applyInArrow(join, schema)


def sweep(intervals: list[tuple[int, int, tuple, str]]) -> list[tuple[int, str]]:
    """Changes of state over time: (day, value), ``''`` where nothing holds.

    ``intervals``: first day, last day, rank and value, sorted by first day. Of
    those that hold on a day, the one with the smallest rank gives the value.
    """
    heap: list[tuple[tuple, str, int]] = []
    out: list[tuple[int, str]] = []

    def note(day: int) -> None:
        while heap and heap[0][2] < day:
            heapq.heappop(heap)
        value = heap[0][1] if heap else ""
        if not out or out[-1][1] != value:
            out.append((day, value))

    def expire(until: int) -> None:
        while heap and heap[0][2] + 1 < until:
            note(heap[0][2] + 1)

    for i, (first, last, rank, value) in enumerate(intervals):
        expire(first)
        heapq.heappush(heap, (rank, value, last))
        if i + 1 == len(intervals) or intervals[i + 1][0] > first:
            note(first)
    expire(OPEN + 2)
    return out


def known_versions(rows: DataFrame, entity: str, value: str, start: str, end: str, known: str, first_day: int, last_day: int) -> DataFrame:
    """``entity``, ``_slice``, ``valid_from`` (day number), ``value``: the state as known on each day.

    On day d the rows known by d count; of rows equal in entity, value and start
    only the one known latest stands (of several, the one that ends last). The
    state is the value of the standing row that holds on d: the one with the
    latest start, then known latest, then the smallest value; ``''`` if none.

    The columns ``start``, ``end``, ``known`` are day numbers, ``end`` may be
    ``OPEN``. Rows with a null entity, value, start or known day never count. Only
    days from ``first_day`` to ``last_day`` are covered; each time slice starts
    anew, so an entity with a long history is spread over tasks.
    """
    full = " and ".join(f"`{c}` is not null" for c in (entity, value, start, known))
    once = rows.where(full).groupBy(entity, value, start, known).agg(F.max(end).alias("_end"))
    later = F.lead(known).over(Window.partitionBy(entity, value, start).orderBy(known))
    held = once.select(
        entity, value, start, known,
        F.greatest(F.col(start), F.col(known), F.lit(first_day)).alias("_a"),
        F.least(F.col("_end"), F.coalesce(later - 1, F.lit(OPEN)), F.lit(last_day)).alias("_b"),
    ).where("_a <= _b")
    slices = F.sequence(F.floor(F.col("_a") / SLICE).cast("int"), F.floor(F.col("_b") / SLICE).cast("int"))
    cut = held.withColumn("_slice", F.explode(slices)).select(
        entity, value, start, known, "_slice",
        F.greatest("_a", F.col("_slice") * SLICE).alias("_a"),
        F.least("_b", F.col("_slice") * SLICE + (SLICE - 1)).alias("_b"),
    )
    placed = cut.repartition(shuffle_partitions(rows.sparkSession), entity, "_slice").sortWithinPartitions(entity, "_slice", "_a")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, at = [], None
        out: list[tuple] = []

        def close() -> None:
            out.extend((at[0], at[1], day, found) for day, found in sweep(group))

        for batch in batches:
            columns = [batch[c].tolist() for c in (entity, "_slice", "_a", "_b", start, known, value)]
            for e, part, a, b, s, k, v in zip(*columns):
                if at != (e, part):
                    if group:
                        close()
                    group, at = [], (e, part)
                group.append((a, b, (-s, -k, v), v))
            if len(out) > 50_000:
                yield pd.DataFrame(out, columns=names)
                out.clear()
        if group:
            close()
        if out:
            yield pd.DataFrame(out, columns=names)

    names = [entity, "_slice", "valid_from", value]
    kind = rows.schema[entity].dataType.simpleString()
    return placed.mapInPandas(run, f"`{entity}` {kind}, _slice int, valid_from int, `{value}` string")


def value_then(events: DataFrame, rows: DataFrame, entity: str, day: str, value: str, start: str, end: str, known: str, name: str) -> DataFrame:
    """``events`` with ``name``: the ``value`` of ``entity`` as known on ``day`` (a day number), ``''`` if none."""
    span = events.agg(F.min(day).alias("a"), F.max(day).alias("b")).first()
    first, last = (0, -1) if span["a"] is None else (span["a"], span["b"])
    versions = known_versions(rows, entity, value, start, end, known, first, last).withColumnRenamed(value, name)
    sliced = events.withColumn("_slice", F.floor(F.col(day) / SLICE).cast("int"))
    joined = asof_left_join(sliced, versions, [entity, "_slice"], day, "valid_from", [name])
    return joined.drop("_slice").withColumn(name, F.coalesce(name, F.lit("")))
