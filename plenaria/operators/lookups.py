"""Lookups by time, by interval and by contained text."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plenaria.operators.asof import asof_left_join

#: Days of a time bucket in interval joins.
BUCKET = 366


def containing(events: DataFrame, spans: DataFrame, on: str, day: str, start: str, end: str) -> DataFrame:
    """Pairs of events and spans of equal ``on`` where ``start`` <= ``day`` <= ``end`` (dates; a null end is open).

    Spans are spread over time buckets up to the last event, so the join is an
    equi-join on entity and bucket, whatever an entity's number of spans.
    """
    bucket = lambda c: F.floor(F.datediff(c, F.lit("1970-01-01").cast("date")) / BUCKET).cast("int")
    edge = events.agg(F.min(day).alias("a"), F.max(day).alias("b")).first()
    if edge["a"] is None:
        edge = {"a": None, "b": None}
    low, high = F.lit(edge["a"]).cast("date"), F.lit(edge["b"]).cast("date")
    first, last = F.greatest(F.col(start), low), F.least(F.coalesce(F.col(end), high), high)
    spread = spans.where(first <= last).withColumn("_bucket", F.explode(F.sequence(bucket(first), bucket(last))))
    found = events.withColumn("_bucket", bucket(F.col(day))).join(spread, [on, "_bucket"])
    return found.where((F.col(start) <= F.col(day)) & (F.col(end).isNull() | (F.col(day) <= F.col(end)))).drop("_bucket")


def next_after(events: DataFrame, later: DataFrame, on: list[str], day: str, later_day: str, take: list[str]) -> DataFrame:
    """Each event with ``take`` of the first ``later`` row of equal ``on`` on or after its day (ties: smallest values).

    An as-of join on days counted backwards: a pair is made for each event found, not for each later row.
    """
    back = lambda c: -F.datediff(c, F.lit("1970-01-01").cast("date"))
    once = later.where(F.col(later_day).isNotNull()).groupBy(*on, later_day).agg(F.min(F.struct(*take)).alias("_f"))
    firsts = once.select(*on, back(F.col(later_day)).alias("_next"), later_day, *[F.col("_f")[c].alias(c) for c in take])
    found = asof_left_join(events.withColumn("_at", back(F.col(day))), firsts, on, "_at", "_next", [later_day, *take])
    return found.where(F.col(later_day).isNotNull()).drop("_at")


def latest(df: DataFrame, key: str, order: list[str], take: list[str]) -> DataFrame:
    """``take`` of each key's row with the greatest ``order`` (nulls first), ties to the greatest values."""
    best = df.groupBy(key).agg(F.max(F.struct(*order, *[F.col(c).alias(f"_t_{c}") for c in take])).alias("_b"))
    return best.select(key, *[F.col("_b")[f"_t_{c}"].alias(c) for c in take])


def longest_contained(texts: DataFrame, key: str, text: str, needles: list[str], name: str = "needle") -> DataFrame:
    """``key`` and the longest of ``needles`` (whole words) that stands in ``text``; ties to the first in order.

    ``needles`` is a dimension of known size held by every task; an automaton reads each text once.
    """
    ranked = sorted(dict.fromkeys(n for n in needles if n), key=lambda n: (-len(n), n))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for i, n in enumerate(ranked):
            automaton.add_word(f" {n} ", i)
        if ranked:
            automaton.make_automaton()
        for batch in batches:
            best = []
            for t in batch[text]:
                found = min((i for _, i in automaton.iter(f" {t} ")), default=None) if ranked and isinstance(t, str) else None
                best.append(None if found is None else ranked[found])
            out = pd.DataFrame({key: batch[key], name: best})
            yield out[out[name].notna()]

    kind = texts.schema[key].dataType.simpleString()
    return texts.select(key, text).mapInPandas(run, f"`{key}` {kind}, `{name}` string")


def shared_words(a: Column, b: Column, least: int) -> Column:
    """Whether two folded titles share ``least`` words: a guard on joins by an unsure key."""
    return F.size(F.array_intersect(F.split(a, " "), F.split(b, " "))) >= least


def same_set(df: DataFrame, key: list[str], member: str, name: str = "members") -> DataFrame:
    """Each key with its set of members in order, so that equal sets join by equality."""
    return df.groupBy(*key).agg(F.array_sort(F.collect_set(member)).alias(name))
