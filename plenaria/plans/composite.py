"""Composite views of a person, a group, a subject or the whole chamber over a period, as rows of parts."""

from __future__ import annotations

from functools import partial, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plenaria.functions.periods import Period, presets
from plenaria.operators.topk import top_k
from plenaria.plans.base import ASIDES, SAID, asides, people, said
from plenaria.sources.tables import table

ROWS = "part string, place int, name string, value double"


def view(spark: SparkSession, sf_dir: str, pid: int | None = None, party: str | None = None, theme: str | None = None, period: Period | str = "all", k: int = 5) -> DataFrame:
    """``part``, ``place``, ``name``, ``value``: what the chosen speeches amount to.

    ``pid``, ``party`` and ``theme`` (by label) narrow the speeches; none of them is the whole chamber.
    ``period`` names a preset or gives months, which are cut to the archive; a period outside it gives no row.

    Parts: ``activity`` (speeches, words, sittings, days, people, and the share of all speeches of the period), ``month`` (speeches in each), and the
    ``k`` first of ``subject``, ``phrase`` (by uses), ``group``, ``speaker``, ``excerpt`` (the latest speeches of 80 words and more with their words) and ``applause`` (groups that applaud).
    """
    every = said(spark, sf_dir, "words")
    edge = every.agg(F.min("month").alias("a"), F.max("month").alias("b")).first()
    empty = spark.createDataFrame([], ROWS)
    if edge["a"] is None:
        return empty
    archive = Period(edge["a"], edge["b"])
    chosen = presets(archive)[period] if isinstance(period, str) else period.within(archive)
    if chosen is None:
        return empty
    labels = table(spark, sf_dir, "topic_labels").where("sid is not null and domain_id is not null").distinct()
    placed = every.where(F.col("month").between(chosen.first, chosen.last))
    own = placed
    for column, value in (("pid", pid), ("party", party)):
        own = own if value is None else own.where(F.col(column) == value)
    if theme is not None:
        own = own.join(labels.where(F.col("domain_id") == theme), "sid", "left_semi")

    def best(part: str, rows: DataFrame, name: str, order: list[Column], value: str = "n") -> DataFrame:
        picked = top_k(rows.withColumn("_all", F.lit(1)), ["_all"], order, k)
        return picked.select(F.lit(part).alias("part"), F.col("rank_no").alias("place"), F.col(name).cast("string").alias("name"), F.col(value).cast("double").alias("value"))

    def counted(part: str, rows: DataFrame, name: str) -> DataFrame:
        return best(part, rows.where(F.col(name).isNotNull() & (F.col(name).cast("string") != "")).groupBy(name).agg(F.count(F.lit(1)).alias("n")), name, [F.desc("n"), F.asc(name)])

    whole = placed.count() or 1
    sums = {"speeches": F.count(F.lit(1)), "words": F.coalesce(F.sum("words"), F.lit(0)), "sittings": F.countDistinct("session_uid"), "days": F.countDistinct("day"), "people": F.countDistinct("pid"), "share": F.round(F.count(F.lit(1)) / F.lit(whole), 9)}
    row = own.agg(*[c.cast("double").alias(n) for n, c in sums.items()])
    activity = row.select(F.explode(F.array(*[F.struct(F.lit("activity").alias("part"), F.lit(i).alias("place"), F.lit(n).alias("name"), F.col(n).alias("value")) for i, n in enumerate(sums, 1)])).alias("_r")).select("_r.*")
    months = own.groupBy("month").agg(F.count(F.lit(1)).alias("n")).select(F.lit("month").alias("part"), F.lit(0).alias("place"), F.col("month").alias("name"), F.col("n").cast("double").alias("value"))
    uses = table(spark, sf_dir, "speech_ngrams", "sid", "gid", "uses").groupBy("sid", "gid").agg(F.max("uses").alias("uses")).join(own.select("sid"), "sid", "left_semi").groupBy("gid").agg(F.sum("uses").alias("n"))
    words = table(spark, sf_dir, "ngrams", "gid", "text").where("text is not null").groupBy("gid").agg(F.min("text").alias("text"))
    phrases = best("phrase", uses.join(words, "gid").where("n is not null"), "text", [F.desc("n"), F.asc("text"), F.asc("gid")])
    excerpts = best("excerpt", own.where("words >= 80 and day is not null"), "sid", [F.desc("day"), F.asc("sid")], "words")
    clapped = asides(spark, sf_dir).where("record_type = 'reaction' and kind = 'applaudissement' and acteur_id <> ''").where(F.date_format("day", "yyyy-MM").between(chosen.first, chosen.last))
    folk = people(spark, sf_dir).select("acteur_id", "pid", "party")
    for column, value in (("pid", pid), ("party", party)):
        folk = folk if value is None else folk.where(F.col(column) == value)
    givers = clapped.join(folk.select("acteur_id"), "acteur_id", "left_semi").select("aside_id", F.explode(F.array_distinct("group_codes")).alias("giver"))
    parts = [activity, months, counted("subject", own.join(labels, "sid"), "domain_id"), phrases, counted("group", own, "party"), counted("speaker", own, "pid"), excerpts, counted("applause", givers, "giver")]
    return reduce(DataFrame.unionByName, parts)


def view_sql(pid: int | None = None, party: str | None = None, theme: str | None = None, period: Period | str = "all", k: int = 5) -> str:
    """:func:`view` in SQL."""
    start = {"all": "a", "year": "greatest(a, strftime(l - INTERVAL 11 MONTH, '%Y-%m'))", "quarter": "greatest(a, strftime(l - INTERVAL 2 MONTH, '%Y-%m'))"}
    months = f"SELECT {start[period]} AS x, b AS y" if isinstance(period, str) else f"SELECT greatest(a, '{period.first}') AS x, least(b, '{period.last}') AS y"
    narrow = [f"pid = {pid}"] * (pid is not None) + [f"party = '{party}'"] * (party is not None)
    mine = " AND ".join([*narrow, *[f"sid IN (SELECT sid FROM lab WHERE domain_id = '{theme}')"] * (theme is not None)]) or "true"

    def best(part: str, rows: str, name: str, order: str, value: str = "n") -> str:
        return f"SELECT '{part}', r::INTEGER, {name}::VARCHAR, {value}::DOUBLE FROM (SELECT *, row_number() OVER (ORDER BY {order}) AS r FROM ({rows})) WHERE r <= {k}"

    def counted(part: str, rows: str, name: str) -> str:
        return best(part, f"SELECT {name}, count(*) AS n FROM {rows} WHERE {name} IS NOT NULL AND {name}::VARCHAR <> '' GROUP BY 1", name, f"n DESC, {name}")

    sums = {"speeches": "count(*)", "words": "coalesce(sum(words), 0)", "sittings": "count(DISTINCT session_uid)", "days": "count(DISTINCT day)", "people": "count(DISTINCT pid)", "share": "round(count(*) / (SELECT count(*) FROM placed), 9)"}
    parts = [f"SELECT 'activity' AS part, {i} AS place, '{n}' AS name, ({c})::DOUBLE AS value FROM own HAVING (SELECT count(*) FROM placed) > 0" for i, (n, c) in enumerate(sums.items(), 1)]
    parts.append("SELECT 'month', 0, month, count(*)::DOUBLE FROM own GROUP BY month")
    parts.append(counted("subject", "own JOIN lab USING (sid)", "domain_id"))
    parts.append(best("phrase", "SELECT gid, text, sum(uses) AS n FROM (SELECT sid, gid, max(uses) AS uses FROM speech_ngrams GROUP BY ALL) JOIN (SELECT gid, min(text) AS text FROM ngrams WHERE text IS NOT NULL GROUP BY 1) USING (gid) WHERE sid IN (SELECT sid FROM own) GROUP BY ALL HAVING sum(uses) IS NOT NULL", "text", "n DESC, text, gid"))
    parts += [counted("group", "own", "party"), counted("speaker", "own", "pid")]
    parts.append(best("excerpt", "SELECT sid, day, words FROM own WHERE words >= 80 AND day IS NOT NULL", "sid", "day DESC, sid", "words"))
    parts.append(counted("applause", f"(SELECT unnest(list_distinct(group_codes)) AS giver FROM aside, d WHERE record_type = 'reaction' AND kind = 'applaudissement' AND strftime(day, '%Y-%m') BETWEEN x AND y AND acteur_id IN (SELECT acteur_id FROM (SELECT acteur_id, pid, coalesce(party, '') AS party FROM politicians) WHERE {' AND '.join(narrow) or 'true'}))", "giver"))
    return f"""WITH {SAID}, {ASIDES}, lab AS (SELECT DISTINCT sid, domain_id FROM topic_labels WHERE sid IS NOT NULL AND domain_id IS NOT NULL), e AS (SELECT min(month) AS a, max(month) AS b FROM said), d AS ({months} FROM (SELECT *, (b || '-01')::DATE AS l FROM e WHERE a IS NOT NULL)),
        placed AS (SELECT said.* FROM said, d WHERE month BETWEEN x AND y), own AS (SELECT * FROM placed WHERE {mine}) """ + " UNION ALL ".join(f"({p})" for p in parts)  # fmt: skip


#: Views as they are asked for: the person who speaks most, a group, a subject, the chamber.
ASKED = {
    "v1_person_view": {"pid": 1, "period": "all"}, "v1_person_year": {"pid": 1, "period": "year"}, "v1_person_on_subject": {"pid": 1, "theme": "sante"},
    "v2_group_view": {"party": "ALV"}, "v2_group_quarter": {"party": "SOL", "period": "quarter"}, "v3_subject_view": {"theme": "budget"}, "v3_subject_in_years": {"theme": "ecole", "period": Period("2020-01", "2022-12")},
    "v4_chamber_view": {}, "v4_chamber_year": {"period": "year"},
}
QUERIES = {name: partial(view, **asked) for name, asked in ASKED.items()}
SQL = {name: view_sql(**asked) for name, asked in ASKED.items()}
