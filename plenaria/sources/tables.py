"""Parquet tables of an archive directory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plenaria.session import broadcast_if_small, checkpoint

#: Tables that a directory may hold.
NAMES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "politicians", "memberships", "seats", "speeches", "ngrams",
    "speech_ngrams", "asides", "transcript_lines", "domains", "topic_labels", "source_targets",
)


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Table ``name`` of the directory; ``columns`` narrows the scan."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def day(column: str | Column) -> Column:
    """The calendar day of a string in any of the archive's spellings, else null.

    ``YYYY-MM-DD``, ``YYYYMMDD`` and both followed by a time are read; the day is
    the one that is written, whatever time zone follows it. Null, ``''`` and days
    that do not exist give null.
    """
    text = F.trim(F.col(column) if isinstance(column, str) else column)
    dashed = F.regexp_extract(text, r"^(\d{4}-\d{2}-\d{2})(?:\D|$)", 1)
    compact = F.regexp_replace(F.regexp_extract(text, r"^(\d{8})(?:\D|$)", 1), r"^(\d{4})(\d{2})(\d{2})$", "$1-$2-$3")
    return F.try_to_date(F.when(dashed != "", dashed).otherwise(compact), "yyyy-MM-dd")


def end_day(column: str | Column) -> Column:
    """Like :func:`day`, but an open end (null, ``''``, ``9999-12-31``) is null."""
    found = day(column)
    return F.when(found < F.lit("9999-12-31").cast("date"), found)


def last_delivered(df: DataFrame, key: str, loaded: str) -> DataFrame:
    """Rows as delivered last, one for each ``key``; keys that came once pass by without a shuffle of the row.

    Of the keys that came again only the rows of the last load are kept; should that hold a key more than once, one of
    them stands, by the least hash of all columns.
    """
    rest = [c for c in df.columns if c != key]
    again = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), F.max(loaded).alias("_last")).where("_n > 1").drop("_n")
    marked = df.join(broadcast_if_small(checkpoint(again).withColumn("_again", F.lit(True))), key, "left")
    single = marked.where("_again is null").select(*df.columns)
    several = marked.where(F.col("_again") & F.col(loaded).eqNullSafe(F.col("_last")))
    picked = several.groupBy(key).agg(F.min_by(F.struct(*rest), F.xxhash64(*rest)).alias("_r"))
    return single.unionByName(picked.select(key, *[F.col("_r")[c].alias(c) for c in rest]))
