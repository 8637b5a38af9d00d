"""Items of varying size in containers of one capacity."""

from __future__ import annotations

import bisect
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plenaria.llm.sizes import TOKENIZER, token_counts
from plenaria.session import checkpoint, shuffle_partitions

#: Items that one task packs.
TASK_ITEMS = 200_000
#: Bins that are merged in one task of the next round come from so many.
FAN_IN = 4
#: A bin filled to this share leaves; the rest are merged further.
NEARLY_FULL = 0.995


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing: lists of positions of ``sizes``, each with a sum up to ``capacity``.

    An item goes to the fullest bin that holds it, else to a new one. Ties go to
    the bin opened last; the order of equal items is their order in ``sizes``.
    """
    bins: list[list[int]] = []
    by_room: dict[int, list[int]] = {}
    rooms: list[int] = []  # rooms with a bin, ascending
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        at = bisect.bisect_left(rooms, sizes[i])
        if at == len(rooms):
            b, room = len(bins), capacity
            bins.append([])
        else:
            room = rooms[at]
            b = by_room[room].pop()
            if not by_room[room]:
                del by_room[room]
                del rooms[at]
        bins[b].append(i)
        left = room - sizes[i]
        if left:
            if left not in by_room:
                by_room[left] = []
                bisect.insort(rooms, left)
            by_room[left].append(b)
    return bins


def _packed(items: DataFrame, capacity: int, level: int) -> DataFrame:
    """Best-fit of the ``size``, ``members`` rows of each partition, as rows of the same kind with ``_id``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sizes: list[int] = []
        members: list[list] = []
        part = None
        for batch in batches:
            if part is None and len(batch):
                part = int(batch["_part"].iloc[0])
            sizes.extend(batch["size"].tolist())
            members.extend(batch["members"].tolist())
        bins = best_fit(sizes, capacity)
        for at in range(0, len(bins), 20_000):
            some = bins[at : at + 20_000]
            yield pd.DataFrame(
                {
                    "_id": [(level << 56) + (part << 32) + at + i for i in range(len(some))],
                    "size": [sum(sizes[i] for i in b) for b in some],
                    "members": [[m for i in b for m in members[i]] for b in some],
                }
            )

    return items.withColumn("_part", F.spark_partition_id()).mapInPandas(run, f"_id bigint, size bigint, members {items.schema['members'].dataType.simpleString()}")


def pack(items: DataFrame, key: str, size: str, capacity: int) -> DataFrame:
    """``container_id``, ``key``, ``piece_no``, ``first_unit``, ``units``: every item in containers of ``capacity``.

    An item is split only if it alone exceeds the capacity, into full pieces and a
    rest (``piece_no`` from 1, ``first_unit`` counts from 0). Items without key or of
    no size (null, 0 or less) hold nothing and are left out; rows of one key count
    once, with the largest size. Equal sizes and an empty table are no special case.

    Method: hierarchical residual packing. Each partition packs its items by best
    fit and emits bins filled to ``NEARLY_FULL``; underfull bins are the items of
    the next round, over a quarter of the partitions (or as many as keep a task to ``TASK_ITEMS``, which
    then get other neighbours), for as many rounds as a tree over the first partitions has levels, whatever the
    size of the input. A bin carries its members' names only, as many at most as the capacity.
    """
    if capacity < 1:
        raise ValueError("the capacity must be positive")
    spark = items.sparkSession
    own = items.where(F.col(key).isNotNull() & (F.col(size) > 0)).groupBy(key).agg(F.max(F.col(size).cast("long")).alias("_size"))
    pieces = F.expr(f"sequence(1L, cast(ceil(_size / {capacity}) as bigint))")
    split = own.withColumn("piece_no", F.explode(pieces))
    first = (F.col("piece_no") - 1) * capacity
    named = split.select(
        F.least(F.col("_size") - first, F.lit(capacity)).alias("size"),
        F.array(F.struct(F.col(key), F.col("piece_no"), first.alias("first_unit"), F.least(F.col("_size") - first, F.lit(capacity)).alias("units"))).alias("members"),
    )
    rows = checkpoint(named)
    width = max(shuffle_partitions(spark), math.ceil(rows.count() / TASK_ITEMS))
    levels = 1 + math.ceil(math.log(width, FAN_IN))  # those of a tree over the partitions
    done: list[DataFrame] = []
    for level in range(levels):
        bins = checkpoint(_packed(rows.repartition(width, F.xxhash64("members", F.lit(level))), capacity, level))
        full = F.col("size") >= math.ceil(NEARLY_FULL * capacity)
        left = bins.where(~full)
        rest = left.count()
        if rest == 0 or level == levels - 1:
            done.append(bins)
            break
        done.append(bins.where(full))
        width = max(1, math.ceil(width / FAN_IN), math.ceil(rest / TASK_ITEMS))
        rows = left.select("size", "members")
    found = done[0]
    for more in done[1:]:
        found = found.unionByName(more)
    return found.select(F.col("_id").alias("container_id"), F.explode("members").alias("_m")).select("container_id", "_m.*")


def pack_documents(documents: DataFrame, capacity: int = 2048, path: str = TOKENIZER) -> DataFrame:
    """The texts of ``documents`` in containers of ``capacity`` tokens; null and empty texts hold none."""
    return pack(token_counts(documents, path=path), "doc_id", "tokens", capacity)
