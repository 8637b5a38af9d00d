"""Which phrases distinguish a group: log-odds, smoothed ratios, TF-IDF, rises."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Weight of the prior, least count, least z.
ALPHA, LEAST_COUNT, LEAST_Z = 1000.0, 3, 1.96


def log_odds(count: Column, total: Column, everyone: Column, everyone_total: Column, prior: Column, alpha0: float = ALPHA) -> tuple[Column, Column]:
    """z and ratio of a phrase by log-odds with an informative Dirichlet prior (Monroe et al., 2008).

    ``everyone`` includes the target; ``prior`` is the phrase's share of the whole
    corpus (0 or null: one use among everyone). Null where the target or the rest has nothing.
    """
    rest, rest_total = F.greatest(everyone - count, F.lit(0)), everyone_total - total
    alpha = F.when(prior > 0, prior * alpha0).otherwise(alpha0 / F.greatest(everyone_total, F.lit(1)))

    def logit(n: Column, whole: Column) -> Column:
        return F.ln((n + alpha) / (whole + alpha0 - n - alpha))

    z = (logit(count, total) - logit(rest, rest_total)) / F.sqrt(1 / (count + alpha) + 1 / (rest + alpha))
    ratio = ((count + 0.5) / (total + 0.5)) / ((rest + 0.5) / (rest_total + 0.5))
    usable = (total > 0) & (rest_total > 0)
    return F.when(usable, z), F.when(usable, ratio)


def distinctive(counts: DataFrame, totals: DataFrame, corpus: DataFrame, group: str, least_sittings: int | None = None) -> DataFrame:
    """Phrases that a group over-uses: ``group``, ``n``, ``ngram``, ``count``, ``rest``, ``z``, ``ratio``.

    ``counts``: group, n, ngram, count (and sittings); ``totals``: group, n, total, with
    phrases that were pruned; ``corpus``: n, ngram, total, corpus. Only rows with
    ``LEAST_COUNT`` uses, in ``least_sittings`` sittings, are scored.
    """
    own = counts.where(F.col("count") >= LEAST_COUNT)
    if least_sittings is not None:
        own = own.where(F.col("sittings") >= least_sittings)
    known = own.join(corpus.select("n", "ngram", F.col("total").alias("_all"), F.col("corpus").alias("_corpus")), ["n", "ngram"])
    placed = known.join(totals.select(group, "n", F.col("total").alias("_own")), [group, "n"])
    c = F.col
    z, ratio = log_odds(c("count"), c("_own"), c("_all"), c("_corpus"), c("_all") / c("_corpus"))
    scored = placed.select(group, "n", "ngram", "count", F.greatest(c("_all") - c("count"), F.lit(0)).alias("rest"), z.alias("z"), ratio.alias("ratio"))
    return scored.where(c("z") >= LEAST_Z)


def smoothed_log_ratio(count: Column, total: Column, rest: Column, rest_total: Column, vocabulary: Column) -> Column:
    """Log of a phrase's rate in a group over its rate in the rest, half a use added to each phrase."""
    return F.ln((count + 0.5) / (total + 0.5 * vocabulary)) - F.ln((rest + 0.5) / (rest_total + 0.5 * vocabulary))


def tfidf_vs_rest(counts: DataFrame, owner: str, least: int = 1) -> DataFrame:
    """TF-IDF of each owner's phrases where document frequency counts the other owners only."""
    own = counts.groupBy(owner, "ngram").agg(F.sum("count").alias("count"))
    df = own.groupBy("ngram").agg(F.count(F.lit(1)).alias("_df"))
    totals = own.groupBy(owner).agg(F.sum("count").alias("_total"))
    owners = own.select(owner).distinct().count()
    idf = F.ln((1 + F.lit(owners - 1)) / (1 + F.col("_df") - 1)) + 1
    scored = own.where(F.col("count") >= least).join(df, "ngram").join(totals, owner)
    return scored.select(owner, "ngram", "count", (F.col("count") / F.col("_total") * idf).alias("tfidf"))


def rising(now: Column, now_total: Column, before: Column, before_total: Column) -> Column:
    """How much more a phrase is used than in the window before; half a use is added there. Null where a window is empty."""
    return F.try_divide(F.try_divide(now, now_total), F.try_divide(before + 0.5, before_total))


def lift(share: Column, overall: Column) -> Column:
    return F.try_divide(share, overall)
