"""Ballots: majorities, cohesion, deviations, absences, levels (bound to orders, customers and nations)."""

from __future__ import annotations

from pyspark.sql import functions as F

from plenaria.functions.text import percent_text
from plenaria.operators import groups
from plenaria.operators.topk import top_k
from plenaria.plans.base import POSITIONS, positions

#: The three positions that a member can take.
NAMES = ["F", "O", "P"]


def _tallied(spark, sf_dir):
    own = positions(spark, sf_dir)
    return own, groups.tallies(own, "ballot", "party", "position", NAMES)


def a16_majority(spark, sf_dir):
    """Tallies and majority of each group on each ballot."""
    return _tallied(spark, sf_dir)[1]


def a18_cohesion(spark, sf_dir):
    """How often the members of a group follow its majority."""
    own, tally = _tallied(spark, sf_dir)
    found = groups.cohesion(groups.with_group(own, tally, "ballot", "party", "position"), "party")
    return found.select("party", "cast", F.round("cohesion", 9).alias("cohesion"), percent_text(F.round("cohesion", 9)).alias("text"))


def a19_deviations(spark, sf_dir):
    """Each member's positions, how many are comparable, and how many deviate."""
    own, tally = _tallied(spark, sf_dir)
    rated = groups.with_group(own, tally, "ballot", "party", "position")
    return rated.groupBy("person").agg(F.count(F.lit(1)).alias("cast"), F.count("agrees").alias("comparable"), F.coalesce(F.sum("agrees"), F.lit(0)).alias("with_group"))


def v8_deviation_list(spark, sf_dir):
    """Each group's ten latest deviations."""
    own, tally = _tallied(spark, sf_dir)
    rated = groups.with_group(own, tally, "ballot", "party", "position").where("agrees = 0")
    return top_k(rated.select("party", "ballot", "person", "position", "majority"), ["party"], [F.desc("ballot"), F.asc("person")], 10)


def j20_missed(spark, sf_dir):
    """Ballots of its group that each member missed."""
    own = positions(spark, sf_dir)
    members = own.select("person", "party").distinct()
    return groups.missed(own, members, own, "ballot", "person", "party").groupBy("person").agg(F.count(F.lit(1)).alias("missed"))


def a20_levels(spark, sf_dir):
    """The stance of each group towards each kind of ballot."""
    own = positions(spark, sf_dir).withColumn("kind", F.substring("ballot", 9, 20))
    counted = own.groupBy("party", "kind").agg(*[F.sum(F.when(F.col("position") == p, 1).otherwise(0)).alias(n) for p, n in zip(NAMES, ("favourable", "unfavourable", "mixed"))])
    return counted.withColumn("level", groups.level(F.col("favourable"), F.col("unfavourable"), F.col("mixed")))


def w22_spans(spark, sf_dir):
    """First and last ballot of each member and its positions by kind."""
    own = positions(spark, sf_dir)
    return own.groupBy("person").agg(F.min("ballot").alias("first"), F.max("ballot").alias("last"), *[F.sum(F.when(F.col("position") == p, 1).otherwise(0)).alias(f"n_{p.lower()}") for p in NAMES])


def v9_ballot_list(spark, sf_dir):
    """The second page of thirty ballots, with the positions of every group as a map."""
    own = positions(spark, sf_dir)
    counted = own.groupBy("ballot").agg(F.count(F.lit(1)).alias("cast"), F.countDistinct("party").alias("groups"))
    return counted.orderBy(F.desc("ballot")).offset(30).limit(30)


_TALLY = f"""WITH {POSITIONS}, t AS (SELECT ballot, party, sum((position = 'F')::INT)::BIGINT AS F, sum((position = 'O')::INT)::BIGINT AS O, sum((position = 'P')::INT)::BIGINT AS P FROM positions GROUP BY ALL),
tally AS (SELECT *, CASE WHEN (F = greatest(F, O, P))::INT + (O = greatest(F, O, P))::INT + (P = greatest(F, O, P))::INT > 1 THEN '' WHEN F = greatest(F, O, P) THEN 'F' WHEN O = greatest(F, O, P) THEN 'O' ELSE 'P' END AS majority FROM t),
rated AS (SELECT p.*, majority, CASE WHEN majority <> '' THEN (position = majority)::INT END AS agrees FROM positions p JOIN tally USING (ballot, party)) """

_ALL = {
    "a16_majority": (a16_majority, _TALLY + "SELECT * FROM tally"),
    "a18_cohesion": (a18_cohesion, _TALLY + """, c AS (SELECT party, count(agrees) AS cast, round(avg(agrees), 9) AS cohesion FROM rated GROUP BY party),
        p AS (SELECT *, cohesion * 100 AS p, floor(cohesion * 100 + 0.5) AS a, floor(cohesion * 1000 + 0.5) / 10 AS b, floor(cohesion * 10000 + 0.5) / 100 AS c FROM c)
        SELECT party, p."cast", cohesion, CASE WHEN cohesion IS NULL THEN '0 %' WHEN NOT (p < 100 AND a >= 100 OR p > 0 AND a <= 0) THEN (a::INT)::VARCHAR || ' %'
        WHEN NOT (p < 100 AND b >= 100 OR p > 0 AND b <= 0) THEN replace(regexp_replace(printf('%.1f', b), '\\.0$', ''), '.', ',') || ' %'
        WHEN NOT (p < 100 AND c >= 100 OR p > 0 AND c <= 0) THEN replace(regexp_replace(printf('%.2f', c), '\\.?0+$', ''), '.', ',') || ' %' WHEN c >= 100 THEN '99,99 %' ELSE '0,01 %' END AS text FROM p"""),
    "a19_deviations": (a19_deviations, _TALLY + "SELECT person, count(*) AS cast, count(agrees) AS comparable, coalesce(sum(agrees), 0)::BIGINT AS with_group FROM rated GROUP BY person"),
    "v8_deviation_list": (v8_deviation_list, _TALLY + """, r AS (SELECT party, ballot, person, position, majority, row_number() OVER (PARTITION BY party ORDER BY ballot DESC, person)::INTEGER AS rank_no FROM rated WHERE agrees = 0) SELECT * FROM r WHERE rank_no <= 10"""),
    "j20_missed": (j20_missed, f"""WITH {POSITIONS}, h AS (SELECT DISTINCT ballot, party FROM positions), m AS (SELECT DISTINCT person, party FROM positions)
        SELECT m.person, count(*) AS missed FROM m JOIN h USING (party) WHERE NOT EXISTS (SELECT 1 FROM positions p WHERE p.ballot = h.ballot AND p.person = m.person) GROUP BY m.person"""),
    "a20_levels": (a20_levels, f"""WITH {POSITIONS}, c AS (SELECT party, substr(ballot, 9) AS kind, sum((position = 'F')::INT)::BIGINT AS favourable, sum((position = 'O')::INT)::BIGINT AS unfavourable, sum((position = 'P')::INT)::BIGINT AS mixed FROM positions GROUP BY ALL)
        SELECT *, CASE WHEN favourable = favourable + unfavourable + mixed THEN 'favorable' WHEN unfavourable = favourable + unfavourable + mixed THEN 'defavorable' WHEN favourable * 3 >= 2 * (favourable + unfavourable + mixed) THEN 'plutot-favorable'
        WHEN unfavourable * 3 >= 2 * (favourable + unfavourable + mixed) THEN 'plutot-defavorable' ELSE 'partage' END AS level FROM c"""),
    "w22_spans": (w22_spans, f"WITH {POSITIONS} SELECT person, min(ballot) AS first, max(ballot) AS last, sum((position = 'F')::INT)::BIGINT AS n_f, sum((position = 'O')::INT)::BIGINT AS n_o, sum((position = 'P')::INT)::BIGINT AS n_p FROM positions GROUP BY person"),
    "v9_ballot_list": (v9_ballot_list, f"WITH {POSITIONS} SELECT ballot, count(*) AS cast, count(DISTINCT party) AS groups FROM positions GROUP BY ballot ORDER BY ballot DESC LIMIT 30 OFFSET 30"),
}
QUERIES = {name: run for name, (run, _) in _ALL.items()}
SQL = {name: sql for name, (_, sql) in _ALL.items() if sql}
