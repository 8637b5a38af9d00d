"""The best rows of every group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank_no") -> DataFrame:
    """The first ``k`` rows of each group of ``keys`` in ``order``, numbered from 1.

    ``order`` should be total. A filter on ``row_number`` lets the optimiser put a
    group limit before the shuffle, so a task sends at most ``k`` rows of a group.
    """
    ranked = df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where(F.col(rank) <= k)
