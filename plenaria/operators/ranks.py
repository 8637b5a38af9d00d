"""Ranks among peers, quantiles of several kinds, and picks that depend on order."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def peer_ranks(df: DataFrame, value: str, pool: list[str]) -> DataFrame:
    """``higher``, ``lower``, ``pool``: peers strictly above and below within a pool; null below two peers.

    Equal values are counted first, so the window orders distinct values only.
    """
    w = Window.partitionBy(*pool).orderBy(value)
    counted = df.where(F.col(value).isNotNull()).groupBy(*pool, value).agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    whole = F.sum("_n").over(Window.partitionBy(*pool))
    placed = counted.select(*pool, value, F.when(whole >= 2, before).alias("lower"), F.when(whole >= 2, whole - before - F.col("_n")).alias("higher"), whole.alias("pool"))
    return df.join(placed, [*pool, value], "left")


def nearest(share: float) -> Callable[[Column], Column]:
    """The place ``round(share * (n - 1))`` among n sorted values, from 0: a decile test over small pools."""
    return lambda n: F.floor(F.lit(share) * (n - 1) + 0.5)


def floored(share: float) -> Callable[[Column], Column]:
    """The place ``floor(share * n)`` among n sorted values, from 0, the last at most."""
    return lambda n: F.least(F.floor(F.lit(share) * n), n - 1)


def values_at(df: DataFrame, keys: list[str], value: str, places: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """For each group the values at some places of its sorted values, as columns named by ``places``; nulls don't count.

    Equal values are counted before the shuffle; a group's distinct values are then passed in order with a
    running count, never held together.
    """
    w = Window.partitionBy(*keys)
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    placed = counted.withColumn("_to", F.sum("_n").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))).withColumn("_all", F.sum("_n").over(w))
    at = {name: F.min(F.when((place(F.col("_all")) < F.col("_to")), F.col(value))) for name, place in places.items()}
    return placed.groupBy(*keys).agg(*[c.alias(name) for name, c in at.items()])


def largest_remainder(df: DataFrame, keys: list[str], weight: str, seats: str, order: str, name: str = "allotted") -> DataFrame:
    """Whole ``seats`` of each group shared out by ``weight``: floors first, then the largest remainders (ties by ``order``)."""
    w = Window.partitionBy(*keys)
    exact = F.col(seats) * F.col(weight) / F.sum(weight).over(w)
    split = df.withColumn("_x", exact).withColumn("_f", F.floor("_x")).withColumn("_left", F.col(seats) - F.sum("_f").over(w))
    ranked = split.withColumn("_r", F.row_number().over(w.orderBy(F.desc(F.col("_x") - F.col("_f")), order)))
    return ranked.withColumn(name, (F.col("_f") + F.when(F.col("_r") <= F.col("_left"), 1).otherwise(0)).cast("long")).drop("_x", "_f", "_left", "_r")


def diverse_first(df: DataFrame, keys: list[str], kind: str, order: list[Column], k: int, rank: str = "pick") -> DataFrame:
    """The first ``k`` rows of each group of ``keys``, the best of each ``kind`` before second ones."""
    within = F.row_number().over(Window.partitionBy(*keys, kind).orderBy(*order))
    first = df.withColumn("_w", within)
    turn = F.when(F.col("_w") == 1, 0).otherwise(1)
    return first.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(turn, *order))).where(F.col(rank) <= k).drop("_w")


def limit_then_distinct(df: DataFrame, keys: list[str], order: list[Column], limit: int, once: str, k: int, rank: str = "pick") -> DataFrame:
    """Of the first ``limit`` rows of each group, the first ``k`` with a new value of ``once``."""
    w = Window.partitionBy(*keys)
    near = df.withColumn("_r", F.row_number().over(w.orderBy(*order))).where(F.col("_r") <= limit)
    new = near.withColumn("_o", F.row_number().over(Window.partitionBy(*keys, once).orderBy("_r"))).where(F.col("_o") == 1)
    return new.withColumn(rank, F.row_number().over(w.orderBy("_r"))).where(F.col(rank) <= k).drop("_r", "_o")


def greedy_diverse(df: DataFrame, group: str, kinds: list[str], order: list[str], k: int) -> DataFrame:
    """Up to ``k`` rows of each group in ``order`` that share none of ``kinds`` with a row taken before.

    The best row of each combination of ``kinds`` is enough, so that many rows come to
    a group's task as it has combinations, not more.
    """
    w = Window.partitionBy(group, *kinds).orderBy(*order)
    best = df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") == 1).drop("_r")

    def pick(rows: pd.DataFrame) -> pd.DataFrame:
        seen: dict[str, set] = {c: set() for c in kinds}
        kept = []
        for i, row in enumerate(rows.sort_values(order, kind="stable").to_dict("records")):
            if len(kept) == k:
                break
            if any(row[c] in seen[c] for c in kinds):
                continue
            for c in kinds:
                seen[c].add(row[c])
            kept.append(row | {"pick": len(kept) + 1})
        return pd.DataFrame(kept, columns=[*rows.columns, "pick"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in best.schema.fields)
    return best.groupBy(group).applyInPandas(pick, f"{fields}, pick int")


def merged_phrases(df: DataFrame, group: str, phrase: str, count: str, size: str, k: int, share: float = 0.5) -> DataFrame:
    """A group's ``k`` best phrases of which none stands within another (``pick`` from 1).

    Of a phrase and a longer one that holds it, the longer stands if it is used at least ``share`` times as often, else the
    shorter. A phrase stays if it stands against each that it meets so. Phrases meet by equality with the spans of
    words within the longer one, not in pairs.
    """
    words = F.split(phrase, " ")
    starts = F.sequence(F.lit(1), F.size("_w"))
    spans = F.flatten(F.transform(starts, lambda i: F.transform(F.sequence(F.lit(1), F.size("_w") - i + 1), lambda n: F.array_join(F.slice("_w", i, n), " "))))
    inner = df.withColumn("_w", words).select(F.col(group), F.col(phrase).alias("_long"), F.col(count).alias("_c"), F.explode(F.array_distinct(spans)).alias(phrase)).where(F.col(phrase) != F.col("_long"))
    met = inner.join(df.select(group, phrase, F.col(count).alias("_s")), [group, phrase])
    lost = met.select(group, F.when(F.col("_c") >= share * F.col("_s"), F.col(phrase)).otherwise(F.col("_long")).alias(phrase)).distinct()
    free = df.join(lost, [group, phrase], "left_anti")
    order = Window.partitionBy(group).orderBy(F.desc(count), F.desc(size), F.asc(phrase))
    return free.withColumn("pick", F.row_number().over(order)).where(F.col("pick") <= k)


def one_to_one(df: DataFrame, a: str, b: str, score: str) -> Iterator[tuple]:
    """Pairs best first, each ``a`` and each ``b`` once. It runs on the driver, for tables of labels: more than 100,000 pairs are refused."""
    used_a, used_b = set(), set()
    if df.limit(100_001).count() > 100_000:
        raise ValueError("too many pairs for the driver")
    for row in df.orderBy(F.desc(score), a, b).toLocalIterator():
        if row[a] not in used_a and row[b] not in used_b:
            used_a.add(row[a])
            used_b.add(row[b])
            yield row[a], row[b], row[score]
