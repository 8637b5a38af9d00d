"""Hot keys: find them from a sample, spread them with salts.

A hot key is one that holds more than its share of a shuffle partition. There are
at most as many of those as partitions, so their list is bounded whatever the size
of the data. Which keys are found only steers where rows go, never a result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plenaria.session import shuffle_partitions

#: Sampled rows for each shuffle partition.
ROWS_PER_PARTITION = 200


def hot_keys(df: DataFrame, key: str, rows: int | None = None) -> list:
    """Keys of ``df`` that hold more than half a partition's share of the rows.

    ``rows`` is the number of rows when it is known; null is never returned.
    """
    parts = shuffle_partitions(df.sparkSession)
    rows = df.count() if rows is None else rows
    if rows == 0:
        return []
    share = min(1.0, ROWS_PER_PARTITION * parts / rows)
    sample = df.select(key).where(F.col(key).isNotNull())
    sample = sample if share == 1.0 else sample.sample(share, seed=7)
    least = max(2, int(rows * share / (2 * parts)))
    return [r[0] for r in sample.groupBy(key).count().where(F.col("count") > least).limit(4 * parts).collect()]


def salt(key: str, spread_by: Column, hot: list, salts: int) -> Column:
    """0 for ordinary keys; for hot ones a number below ``salts`` drawn from ``spread_by``."""
    if not hot:
        return F.lit(0)
    return F.when(F.col(key).isin(hot), F.pmod(F.xxhash64(spread_by), F.lit(salts)).cast("int")).otherwise(0)


def all_salts(df: DataFrame, key: str, hot: list, salts: int, name: str = "_salt") -> DataFrame:
    """The other side of a salted join: rows of hot keys once for each salt."""
    if not hot:
        return df.withColumn(name, F.lit(0))
    every = F.when(F.col(key).isin(hot), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    return df.withColumn(name, F.explode(every))
