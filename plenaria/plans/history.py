"""Memberships and seats over time (problems 5 and 6)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plenaria.operators.asof import value_then
from plenaria.operators.intervals import OPEN, periods_and_gaps
from plenaria.session import broadcast_if_small
from plenaria.sources.tables import day, end_day, table


def _number(date: Column) -> Column:
    return F.datediff(date, F.lit("1970-01-01").cast("date"))


def group_then(speeches: DataFrame, politicians: DataFrame, memberships: DataFrame) -> DataFrame:
    """``sid``, ``acteur_id``, ``day``, ``recorded``, ``party_then`` of every speech of a known politician.

    ``recorded`` is the speech's party in upper case without outer blanks, null
    read as ``''``. A speech delivered again counts once, as delivered last. Speeches
    without ``pid`` or with one that ``politicians`` lacks are left out; one without
    a readable day has ``party_then`` ``''``.
    """
    fields = F.struct("pid", "party", "speech_date")
    loaded = F.coalesce("loaded_at", F.lit("1970-01-01").cast("timestamp"))
    latest = speeches.where("sid is not null and pid is not null").groupBy("sid").agg(F.max_by(fields, loaded).alias("_r"))
    said = latest.select(
        "sid", F.col("_r.pid").alias("pid"), _number(day("_r.speech_date")).alias("day"),
        F.upper(F.trim(F.coalesce("_r.party", F.lit("")))).alias("recorded"),
    )
    people = politicians.where("pid is not null and acteur_id is not null").groupBy("pid").agg(F.max("acteur_id").alias("acteur_id"))
    events = said.join(broadcast_if_small(people), "pid").select("sid", "acteur_id", "day", "recorded")
    rows = memberships.select(
        "acteur_id", F.coalesce("party", F.lit("")).alias("party"), _number(day("start_date")).alias("_start"),
        F.coalesce(_number(end_day("end_date")), F.lit(OPEN)).alias("_end"), _number(day("known_on")).alias("_known"),
    )
    return value_then(events, rows, "acteur_id", "day", "party", "_start", "_end", "_known", "party_then")


def standing(memberships: DataFrame) -> DataFrame:
    """Membership rows that stand once all is known: the latest known of equal person, party and start."""
    known = F.coalesce(day("known_on"), F.lit("0001-01-01").cast("date"))
    end = F.coalesce(end_day("end_date"), F.lit("9999-12-31").cast("date"))
    rows = memberships.select("acteur_id", F.coalesce("party", F.lit("")).alias("party"), day("start_date").alias("start_date"), known.alias("known"), end.alias("end_date"))
    latest = rows.groupBy("acteur_id", "party", "start_date").agg(F.max(F.struct("known", "end_date")).alias("_r"))
    return latest.select("acteur_id", "start_date", F.when(F.col("_r.end_date") < F.lit("9999-12-31").cast("date"), F.col("_r.end_date")).alias("end_date"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Speeches whose recorded group isn't the one their speaker was then known to sit in."""
    then = p5_group_then(spark, sf_dir)
    return then.where("recorded <> upper(trim(party_then))").select("sid", "party_then")


def p5_group_then(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The group known on the day, for every speech of a politician."""
    said = table(spark, sf_dir, "speeches", "sid", "pid", "party", "speech_date", "loaded_at")
    people = table(spark, sf_dir, "politicians", "pid", "acteur_id")
    found = group_then(said, people, table(spark, sf_dir, "memberships"))
    return found.select("sid", "acteur_id", "recorded", "party_then")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Continuous periods of memberships and of seats, and the gaps between them."""
    members = standing(table(spark, sf_dir, "memberships")).withColumn("interval_kind", F.lit("membership"))
    seats = table(spark, sf_dir, "seats", "acteur_id", "start_date", "end_date")
    held = seats.select("acteur_id", day("start_date").alias("start_date"), end_day("end_date").alias("end_date"), F.lit("seat").alias("interval_kind"))
    found = periods_and_gaps(members.unionByName(held), ["acteur_id", "interval_kind"], "start_date", "end_date")
    return found.select(
        "acteur_id", "interval_kind", "result_kind", F.date_format("start_date", "yyyy-MM-dd").alias("start_date"),
        F.coalesce(F.date_format("end_date", "yyyy-MM-dd"), F.lit("")).alias("end_date"),
    )


def day_sql(c: str) -> str:
    """The day of a column in SQL, as :func:`plenaria.sources.tables.day` reads it."""
    t = f"trim({c})"
    return (
        rf"try_cast(CASE WHEN regexp_matches({t}, '^\d{{4}}-\d{{2}}-\d{{2}}(\D|$)') THEN substr({t}, 1, 10) "
        rf"WHEN regexp_matches({t}, '^\d{{8}}(\D|$)') THEN substr({t}, 1, 4) || '-' || substr({t}, 5, 2) || '-' || substr({t}, 7, 2) END AS DATE)"
    )


_FAR = "DATE '9999-12-31'"
_MEMBERS = f"""WITH members AS (SELECT acteur_id, coalesce(party, '') AS party, {day_sql("start_date")} AS s,
coalesce({day_sql("end_date")}, {_FAR}) AS e, {day_sql("known_on")} AS k FROM memberships) """

_P5 = (
    _MEMBERS
    + f""", said AS (SELECT DISTINCT ON (sid) sid, pid, upper(trim(coalesce(party, ''))) AS recorded, {day_sql("speech_date")} AS d
FROM speeches WHERE sid IS NOT NULL AND pid IS NOT NULL ORDER BY sid, loaded_at DESC NULLS LAST),
events AS (SELECT sid, acteur_id, recorded, d FROM said JOIN (SELECT DISTINCT pid, acteur_id FROM politicians) USING (pid)),
known AS (SELECT sid, d, m.party, m.s, m.k, m.e, row_number() OVER (PARTITION BY sid, m.party, m.s ORDER BY m.k DESC, m.e DESC) AS r
FROM events JOIN members m ON m.acteur_id = events.acteur_id AND m.k <= events.d AND m.s IS NOT NULL),
then_ AS (SELECT sid, party, row_number() OVER (PARTITION BY sid ORDER BY s DESC, k DESC, party) AS r FROM known WHERE r = 1 AND s <= d AND d <= e),
found AS (SELECT events.sid, acteur_id, recorded, coalesce(party, '') AS party_then FROM events LEFT JOIN then_ ON then_.sid = events.sid AND then_.r = 1) """
)

_P6 = (
    _MEMBERS
    + f""", spans AS (SELECT acteur_id, 'membership' AS interval_kind, s, e FROM
(SELECT *, row_number() OVER (PARTITION BY acteur_id, party, s ORDER BY k DESC NULLS LAST, e DESC) AS r FROM members) WHERE r = 1
UNION ALL SELECT acteur_id, 'seat', {day_sql("start_date")}, coalesce({day_sql("end_date")}, {_FAR}) FROM seats),
own AS (SELECT * FROM spans WHERE acteur_id IS NOT NULL AND s IS NOT NULL AND s <= e),
reached AS (SELECT *, max(e) OVER (PARTITION BY acteur_id, interval_kind ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM own),
marked AS (SELECT *, CASE WHEN before IS NULL OR s - 1 > before THEN 1 ELSE 0 END AS fresh FROM reached),
numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY acteur_id, interval_kind ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM marked),
periods AS (SELECT acteur_id, interval_kind, min(s) AS s, max(e) AS e FROM numbered GROUP BY acteur_id, interval_kind, island),
followed AS (SELECT *, lead(s) OVER (PARTITION BY acteur_id, interval_kind ORDER BY s) AS next FROM periods)
SELECT acteur_id, interval_kind, 'period' AS result_kind, strftime(s, '%Y-%m-%d') AS start_date, CASE WHEN e < {_FAR} THEN strftime(e, '%Y-%m-%d') ELSE '' END AS end_date FROM periods
UNION ALL SELECT acteur_id, interval_kind, 'gap', strftime(e + 1, '%Y-%m-%d'), strftime(next - 1, '%Y-%m-%d') FROM followed WHERE next IS NOT NULL"""
)

QUERIES = {"p5_found": p5_found, "p5_group_then": p5_group_then, "p6_found": p6_found}
SQL = {
    "p5_found": _P5 + "SELECT sid, party_then FROM found WHERE recorded <> upper(trim(party_then))",
    "p5_group_then": _P5 + "SELECT * FROM found",
    "p6_found": _P6,
}
