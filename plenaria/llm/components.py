"""Connected components over a DataFrame of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plenaria.session import checkpoint


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node``, ``component`` (its smallest node) of every node that ``links`` names.

    Alternating large-star and small-star rounds (Kiveris et al., 2014) until no
    link changes; they halve long chains, so the rounds grow with the logarithm of
    the diameter. Each round is written to the checkpoint folder. Links with a null
    end are left out; loops and repeated links change nothing.
    """
    x, y = F.col(a), F.col(b)
    edges = links.where(x.isNotNull() & y.isNotNull() & (x != y)).select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).distinct()
    edges = checkpoint(edges)
    while True:
        # large-star: every larger neighbour goes to the smallest neighbour or the node itself
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small-star: every smaller neighbour goes to the smallest one
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(joined.select("u", F.col("m").alias("v")))
        after = checkpoint(small.where("u <> v").distinct())
        if after.count() == edges.count() and after.join(edges, ["u", "v"], "left_anti").isEmpty():
            break
        edges = after
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component")).distinct()
