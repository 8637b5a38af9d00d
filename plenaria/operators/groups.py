"""Positions of groups and their members: majorities, cohesion, levels, misses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def majority(counts: dict[str, Column]) -> Column:
    """The most frequent position; ``''`` if nobody took one or two are tied."""
    ranked = F.array_sort(F.array(*[F.struct((-c).alias("n"), F.lit(name).alias("p")) for name, c in counts.items()]))
    first, second = ranked[0], ranked[1]
    return F.when((first["n"] == 0) | (first["n"] == second["n"]), "").otherwise(first["p"])


def tallies(positions: DataFrame, ballot: str, group: str, position: str, names: list[str]) -> DataFrame:
    """One row for each ballot and group: a column for each position, and ``majority``."""
    sums = [F.sum(F.when(F.col(position) == p, 1).otherwise(0)).alias(p) for p in names]
    return positions.groupBy(ballot, group).agg(*sums).withColumn("majority", majority({p: F.col(p) for p in names}))


def with_group(positions: DataFrame, tally: DataFrame, ballot: str, group: str, position: str) -> DataFrame:
    """Positions with their group's majority and whether they agree (null where the group has none)."""
    joined = positions.join(tally.select(ballot, group, "majority"), [ballot, group])
    return joined.withColumn("agrees", F.when(F.col("majority") != "", (F.col(position) == F.col("majority")).cast("int")))


def cohesion(agreeing: DataFrame, group: str) -> DataFrame:
    """``group``, ``cast``, ``cohesion``: the share of positions that follow the group's majority."""
    return agreeing.groupBy(group).agg(F.count("agrees").alias("cast"), F.avg("agrees").alias("cohesion"))


def missed(held: DataFrame, members: DataFrame, cast: DataFrame, ballot: str, person: str, group: str) -> DataFrame:
    """Ballots of a person's group in which that person took no position."""
    due = members.join(held.select(ballot, group).distinct(), group)
    return due.join(cast.select(ballot, person), [ballot, person], "left_anti")


def level(favourable: Column, unfavourable: Column, mixed: Column) -> Column:
    """A group's stance from its members': whole, two thirds, or shared; ``non-exprime`` without any."""
    total = favourable + unfavourable + mixed
    return (
        F.when(total == 0, "non-exprime").when(favourable == total, "favorable").when(unfavourable == total, "defavorable")
        .when(favourable * 3 >= total * 2, "plutot-favorable").when(unfavourable * 3 >= total * 2, "plutot-defavorable").otherwise("partage")
    )
