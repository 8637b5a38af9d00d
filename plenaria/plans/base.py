"""The archive's records as the views read them, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plenaria.functions.text import tokens, words_only
from plenaria.plans.history import day_sql
from plenaria.session import spread
from plenaria.sources.tables import day, last_delivered, table


def said(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """Speeches once each, as delivered last, with clean group and day; ``more`` names further columns.

    Only the keys that came again, with their last load time, are joined: texts aren't shuffled. Deliveries
    of one load time agree, so any stands for all.
    """
    df = table(spark, sf_dir, "speeches", "sid", "pid", "party", "speech_date", "session_uid", "loaded_at", *more)
    keyed = df.where("sid is not null")
    once = last_delivered(spread(keyed) if "content" in more else keyed, "sid", "loaded_at").drop("loaded_at")
    return once.withColumn("party", F.upper(F.trim(F.coalesce("party", F.lit(""))))).withColumn("day", day("speech_date")).withColumn("month", F.date_format("day", "yyyy-MM")).drop("speech_date")


def spoken(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Speeches with ``tokens``: the words of the whole content."""
    text = F.array_join(F.coalesce("content", F.array().cast("array<string>")), "\n")
    return said(spark, sf_dir, "content").withColumn("tokens", tokens(words_only(text))).drop("content")


def asides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Asides once each, with ``day`` and empty strings for missing ones."""
    df = table(spark, sf_dir, "asides").dropDuplicates(["aside_id"])
    return df.withColumn("day", day("aside_date")).withColumn("kind", F.coalesce("kind", F.lit(""))).withColumn("acteur_id", F.coalesce("acteur_id", F.lit("")))


def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "politicians").withColumn("party", F.coalesce("party", F.lit("")))


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ballots, groups and positions, bound to the order tables.

    A ballot is a priority in a month, a member a customer, a group a nation; a
    member's position is the status of the latest order on the ballot.
    """
    orders = table(spark, sf_dir, "orders")
    ballot = F.concat(F.date_format("o_orderdate", "yyyy-MM"), F.lit(" "), F.col("o_orderpriority"))
    last = orders.groupBy(ballot.alias("ballot"), F.col("o_custkey").alias("person")).agg(F.max(F.struct("o_orderdate", "o_orderkey", "o_orderstatus")).alias("_o"))
    members = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("person"), F.col("c_nationkey").alias("party"))
    return last.select("ballot", "person", F.col("_o.o_orderstatus").alias("position")).join(members, "person")


#: Words of a text in SQL, as :func:`plenaria.functions.text.words_only`.
def words_sql(c: str) -> str:
    t = f"lower(translate({c}, '’‘ʼ`´\u00a0\u202f', repeat(chr(39), 5) || '  '))"
    t = rf"regexp_replace({t}, '(^|[^\p{{L}}\p{{N}}_])n\s*[°º]\s*', '\1 ', 'g')"
    t = rf"regexp_replace({t}, '(^|[^\p{{L}}\p{{N}}_])nos?\s+([0-9])', '\1 \2', 'g')"
    t = rf"regexp_replace({t}, '(^|[^\p{{L}}\p{{N}}_])[0-9]+([.,][0-9]+)*(er|re|e|ème|eme|es|s)?($|[^\p{{L}}\p{{N}}_])', '\1 \4', 'g')"
    return rf"trim(regexp_replace({t}, '[^\p{{L}}]+', ' ', 'g'))"


def fold_sql(c: str) -> str:
    from plenaria.functions.text import ACCENTED, BARE

    return f"trim(regexp_replace(translate(lower({c}), '{ACCENTED}', '{BARE}'), '[^a-z0-9]+', ' ', 'g'))"


SAID = f"""said AS (SELECT sid, pid, upper(trim(coalesce(party, ''))) AS party, {day_sql("speech_date")} AS day, strftime({day_sql("speech_date")}, '%Y-%m') AS month,
session_uid, debate_title, dossier_title, section_code, bill_number, words, tokens AS n_tokens, content
FROM (SELECT *, row_number() OVER (PARTITION BY sid ORDER BY loaded_at) AS r FROM speeches WHERE sid IS NOT NULL) WHERE r = 1)"""
SPOKEN = f"""{SAID}, spoken AS (SELECT * EXCLUDE (content), list_filter(string_split({words_sql("coalesce(array_to_string(content, chr(10)), '')")}, ' '), lambda x: x <> '') AS tokens FROM said)"""
ASIDES = f"""aside AS (SELECT * REPLACE (coalesce(kind, '') AS kind, coalesce(acteur_id, '') AS acteur_id), {day_sql("aside_date")} AS day
FROM (SELECT *, row_number() OVER (PARTITION BY aside_id) AS r FROM asides) WHERE r = 1)"""
POSITIONS = """positions AS (SELECT ballot, person, c_nationkey AS party, position FROM (
SELECT strftime(o_orderdate, '%Y-%m') || ' ' || o_orderpriority AS ballot, o_custkey AS person, o_orderstatus AS position,
row_number() OVER (PARTITION BY strftime(o_orderdate, '%Y-%m') || ' ' || o_orderpriority, o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders)
JOIN customer ON c_custkey = person WHERE r = 1)"""


def grams_sql(sizes: tuple[int, ...], keep: str) -> str:
    parts = [
        f"SELECT {keep}, {n} AS n, array_to_string(tokens[i:i + {n - 1}], ' ') AS ngram FROM (SELECT *, unnest(range(1, len(tokens) - {n} + 2)) AS i FROM spoken WHERE len(tokens) >= {n})"
        for n in sizes
    ]
    return "grams AS (" + " UNION ALL ".join(parts) + ")"
