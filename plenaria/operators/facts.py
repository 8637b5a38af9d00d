"""Counting: n-gram facts, totals at several grains, dense tables, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plenaria.functions.text import ngrams


def exploded_ngrams(df: DataFrame, words: str, sizes: tuple[int, ...], keep: list[str]) -> DataFrame:
    """One row for each n-gram, of all sizes in one pass: ``keep``, ``n``, ``ngram``. None crosses a row."""
    every = F.array(*[F.struct(F.lit(n).alias("n"), ngrams(F.col(words), n).alias("grams")) for n in sizes])
    sized = df.select(*keep, F.explode(every).alias("_g"))
    return sized.select(*keep, F.col("_g.n").alias("n"), F.explode("_g.grams").alias("ngram"))


def ngram_totals(df: DataFrame, words: str, sizes: tuple[int, ...], keys: list[str]) -> DataFrame:
    """How many n-grams of each size ``keys`` have, without making them."""
    size = F.size(words)
    sums = [F.sum(F.greatest(size - (n - 1), F.lit(0))).alias(f"_{n}") for n in sizes]
    wide = df.groupBy(*keys).agg(*sums)
    return wide.select(*keys, F.explode(F.array(*[F.struct(F.lit(n).alias("n"), F.col(f"_{n}").alias("total")) for n in sizes])).alias("_t")).select(*keys, "_t.*")


def pruned_counts(grams: DataFrame, least: int) -> DataFrame:
    """``n``, ``ngram``, ``total``, ``corpus``: the n-grams used ``least`` times; the corpus is counted before pruning."""
    counted = grams.groupBy("n", "ngram").agg(F.count(F.lit(1)).alias("total"))
    corpus = counted.groupBy("n").agg(F.sum("total").alias("corpus"))
    return counted.where(F.col("total") >= least).join(F.broadcast(corpus), "n")  # one row for each size


def grouped_at(df: DataFrame, grains: list[list[str]], aggregates: list[Column]) -> DataFrame:
    """One table of aggregates at several grains; keys that a grain lacks are null, ``grain`` names it."""
    keys = list(dict.fromkeys(k for g in grains for k in g))
    sets = [[F.col(k) for k in g] for g in grains]
    level = F.grouping_id().alias("grain")
    return df.groupingSets(sets, *keys).agg(level, *aggregates)


def dense_counts(df: DataFrame, keys: list[str], member: str, members: list[str], name: str = "count") -> DataFrame:
    """Counts for every one of the listed ``members`` in every group of ``keys``, zeros included."""
    counted = [F.sum(F.when(F.col(member) == m, 1).otherwise(0)).alias(f"_{i}") for i, m in enumerate(members)]
    wide = df.groupBy(*keys).agg(*counted)
    every = F.array(*[F.struct(F.lit(m).alias(member), F.col(f"_{i}").alias(name)) for i, m in enumerate(members)])
    return wide.select(*keys, F.explode(every).alias("_m")).select(*keys, "_m.*")


def first_distinct(df: DataFrame, key: str, value: str, order: str, k: int) -> DataFrame:
    """``key`` and its first ``k`` distinct values in ``order`` (repeats count where they first stand), as ``values``."""
    firsts = df.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.min(order).alias("_at"))
    ranked = firsts.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy("_at", value))).where(F.col("_r") <= k)
    listed = ranked.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_r", value))).alias("_v"))
    return listed.select(key, F.transform("_v", lambda x: x[value]).alias("values"))


def summary(df: DataFrame, columns: list[str]) -> DataFrame:
    """``metric``, ``least``, ``most``, ``mean`` of each numeric column."""
    aggs = [f(c).alias(f"{c}_{n}") for c in columns for n, f in (("least", F.min), ("most", F.max), ("mean", F.avg))]
    row = df.agg(*aggs)
    every = F.array(*[F.struct(F.lit(c).alias("metric"), *[F.col(f"{c}_{n}").cast("double").alias(n) for n in ("least", "most", "mean")]) for c in columns])
    return row.select(F.explode(every).alias("_m")).select("_m.*")


def trend(recent: Column, previous: Column, by: float = 0.2) -> Column:
    """``new``, ``rising``, ``falling`` or ``stable`` of two neighbouring windows."""
    return (
        F.when((previous == 0) & (recent > 0), "new").when(recent > previous * (1 + by), "rising").when(recent < previous * (1 - by), "falling").otherwise("stable")
    )


def stratified_sample(df: DataFrame, stratum: str, key: str, size: int, seed: int) -> DataFrame:
    """``size`` rows of each stratum, the same ones for a seed, wherever rows lie."""
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))
    ranked = df.withColumn("_r", F.row_number().over(Window.partitionBy(stratum).orderBy(order, key)))
    return ranked.where(F.col("_r") <= size).drop("_r")


def precision_by(df: DataFrame, method: str, right: str) -> DataFrame:
    """``method``, ``judged``, ``precision``, ``weight`` (its share of all rows); ``right`` null means not judged."""
    rated = df.groupBy(method).agg(F.count(F.lit(1)).alias("_n"), F.count(right).alias("judged"), F.avg(F.col(right).cast("double")).alias("precision"))
    whole = rated.agg(F.sum("_n")).first()[0] or 1  # one number
    return rated.select(method, "judged", "precision", (F.col("_n") / F.lit(whole)).alias("weight"))
