"""The chamber: interruptions, reactions, rankings, favourite lines, seats and lookups."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from plenaria.functions.text import contains_phrase, fold, fold_punctuated, iso_week, paragraphs, person_slug, place_query, rate_per_thousand, safe_name, sentences, share_of, shortened, slug
from plenaria.operators import facts, lookups, ranks
from plenaria.operators.lexical import lift
from plenaria.operators.topk import top_k
from plenaria.plans.base import ASIDES, SAID, asides, fold_sql, people, said
from plenaria.plans.history import day_sql, standing
from plenaria.session import broadcast_if_small
from plenaria.sources.tables import day, end_day, table


def v6_chamber(spark, sf_dir):
    """Each person's sittings (spoken or interrupted), speeches, words and interruptions."""
    own = said(spark, sf_dir, "words").where("pid is not null")
    folk = people(spark, sf_dir).select("pid", "acteur_id")
    cut = asides(spark, sf_dir).where("record_type = 'interruption' and acteur_id <> ''").join(folk, "acteur_id")
    present = own.select("pid", "session_uid").unionByName(cut.select("pid", "session_uid")).distinct().groupBy("pid").agg(F.count(F.lit(1)).alias("sittings"))
    spoke = own.groupBy("pid").agg(F.count(F.lit(1)).alias("speeches"), F.sum("words").alias("words"))
    heckled = cut.groupBy("pid").agg(F.count(F.lit(1)).alias("interruptions"))
    return present.join(spoke, "pid", "left").join(heckled, "pid", "left").fillna(0, ["speeches", "words", "interruptions"])


def w2_peer_ranks(spark, sf_dir):
    """Interruptions by sitting of those with three sittings or more, with the peers above and below in their group."""
    rate = F.round(F.col("interruptions") / F.col("sittings"), 9)
    own = v6_chamber(spark, sf_dir).where("sittings >= 3").join(people(spark, sf_dir).select("pid", "party"), "pid").select("pid", "party", rate.alias("rate"))
    return ranks.peer_ranks(own, "rate", ["party"]).select("pid", "party", "rate", "lower", "higher", "pool")


def w3_more_active(spark, sf_dir):
    """The share of a group's members, silent ones included, with strictly fewer speeches."""
    spoke = said(spark, sf_dir).where("pid is not null").groupBy("pid").agg(F.count(F.lit(1)).alias("speeches"))
    every = people(spark, sf_dir).select("pid", "party").join(spoke, "pid", "left").fillna(0, ["speeches"])
    ranked = ranks.peer_ranks(every, "speeches", ["party"])
    return ranked.select("pid", "party", "speeches", F.round(share_of("lower", "pool"), 9).alias("more_active_than"))


def w4_quantiles(spark, sf_dir):
    """Median, deciles of three kinds and mean of the words of each group's speeches."""
    own = said(spark, sf_dir, "words").where("party <> '' and words is not null").withColumn("words", F.col("words").cast("long"))
    placed = ranks.values_at(own, ["party"], "words", {"nearest": ranks.nearest(0.9), "floor": ranks.floored(0.1)})
    return own.groupBy("party").agg(F.median("words").alias("median"), F.round(F.percentile("words", 0.9), 9).alias("interpolated"), F.round(F.avg("words"), 9).alias("mean")).join(placed, "party")


def w8_favourites(spark, sf_dir):
    """Lines that a person repeats: three times in three sittings, at twice the rate of everyone else; five at most."""
    own = asides(spark, sf_dir).where("record_type = 'interruption' and acteur_id <> '' and norm <> ''")
    mine = own.groupBy("acteur_id", "norm").agg(F.count(F.lit(1)).alias("count"), F.countDistinct("session_uid").alias("sittings"), F.max(F.struct("day", "aside_id", "quote"))["quote"].alias("quote"))
    total, every = own.groupBy("acteur_id").agg(F.count(F.lit(1)).alias("_mine")), own.groupBy("norm").agg(F.count(F.lit(1)).alias("_line"))
    whole = own.count()
    joined = mine.where("count >= 3 and sittings >= 3").join(total, "acteur_id").join(every, "norm").withColumn("rest", F.col("_line") - F.col("count"))
    often = (F.col("rest") == 0) | (F.col("count") / F.col("_mine") >= 2 * F.try_divide(F.col("rest"), F.lit(whole) - F.col("_mine")))
    return top_k(joined.where(often).select("acteur_id", "norm", "count", "sittings", "rest", "quote"), ["acteur_id"], [F.desc("count"), F.desc("sittings"), F.asc("quote")], 5)


def w9_moments(spark, sf_dir):
    """Each person's three most widely applauded sentences: of the first sixty, each once, six words or more."""
    own = asides(spark, sf_dir).where("record_type = 'reaction' and kind = 'applaudissement' and acteur_id <> '' and norm <> ''")
    wide = F.when(F.col("every_bench") == 1, 5).otherwise(F.greatest(F.size(F.array_distinct(F.coalesce("group_codes", F.array().cast("array<string>")))), F.coalesce("unnamed_benches", F.lit(0))))
    placed = own.select("acteur_id", "aside_id", "norm", "day", wide.alias("camps"), F.size(F.split("norm", " ")).alias("_words"))
    found = ranks.limit_then_distinct(placed, ["acteur_id"], [F.desc("camps"), F.desc("day"), F.asc("aside_id")], 60, "norm", 60).where("_words >= 6")
    return top_k(found.select("acteur_id", "aside_id", "norm", "camps", "pick"), ["acteur_id"], [F.asc("pick")], 3).select("acteur_id", "aside_id", "norm", "camps", "rank_no")


def w10_diverse(spark, sf_dir):
    """Six speeches of each debate, the first of every group before second ones."""
    own = said(spark, sf_dir, "debate_title", "words").where("debate_title <> '' and words >= 80")
    return ranks.diverse_first(own.select("debate_title", "party", "sid", "day", "words"), ["debate_title"], "party", [F.desc("day"), F.asc("sid")], 6)


def w11_greedy(spark, sf_dir):
    """Six speeches of each sitting of which no two share a group or a speaker."""
    own = said(spark, sf_dir, "words").where("pid is not null and words is not null").select("session_uid", "party", "pid", (-F.col("words")).alias("order_words"), "sid")
    return ranks.greedy_diverse(own, "session_uid", ["party", "pid"], ["order_words", "sid"], 6)


def w13_leaders(spark, sf_dir):
    """The ten who interrupt most by sitting, and the ten who do in all."""
    own = v6_chamber(spark, sf_dir).where("interruptions > 0 and sittings > 0").withColumn("per_sitting", F.round(F.col("interruptions") / F.col("sittings"), 9))
    by = {"sitting": [F.desc("per_sitting"), F.desc("interruptions"), F.asc("pid")], "total": [F.desc("interruptions"), F.desc("per_sitting"), F.asc("pid")]}
    lists = [own.orderBy(*order).limit(10).select(F.lit(name).alias("list"), "pid", "sittings", "interruptions", "per_sitting") for name, order in by.items()]
    return lists[0].unionByName(lists[1])


def w18_remainder(spark, sf_dir):
    """Fifty seats of each department shared out to its constituencies by their mandates."""
    own = table(spark, sf_dir, "seats", "department", "constituency_no").where("department <> '' and constituency_no is not null").groupBy("department", "constituency_no").agg(F.count(F.lit(1)).alias("mandates"))
    return ranks.largest_remainder(own.withColumn("seats", F.lit(50)), ["department"], "mandates", "seats", "constituency_no").drop("seats")


#: Searches that the query answers; the operator takes any.
SEARCHES = ("vernes", "val", "mont", "de", "cotes d ombre", "loire", "zzz")


def w19_place_search(spark, sf_dir, searches=SEARCHES):
    """For each search the eight departments that match best: whole name, start, word start, within."""
    own = table(spark, sf_dir, "seats", "department", "department_name").where("department_name <> ''").groupBy("department", "department_name").agg(F.count(F.lit(1)).alias("mandates"))
    asked = own.withColumn("search", F.explode(F.array(*[F.lit(s) for s in searches]))).withColumn("key", place_query("department_name"))
    key, query = F.col("key"), F.col("search")
    score = F.when(key == query, 0).when(F.startswith(key, query), 1).when(F.contains(F.concat(F.lit(" "), key), F.concat(F.lit(" "), query)), 2).when(F.contains(key, query), 3)
    found = asked.withColumn("score", score).where("score is not null")
    return top_k(found, ["search"], [F.asc("score"), F.asc(F.length("department_name")), F.asc("department_name"), F.asc("department")], 8).drop("key")


def w21_angles(spark, sf_dir):
    """For each department its most and least active member, its most common group."""
    seat = lookups.latest(table(spark, sf_dir, "seats").withColumn("_s", day("start_date")).where("_s is not null and department <> ''"), "acteur_id", ["_s"], ["department"])
    spoke = said(spark, sf_dir).where("pid is not null").groupBy("pid").agg(F.count(F.lit(1)).alias("speeches"))
    own = people(spark, sf_dir).join(seat, "acteur_id").join(spoke, "pid", "left").fillna(0, ["speeches"])
    best, least = F.max(F.struct("speeches", "pid")), F.min(F.struct("speeches", "pid"))
    counted = own.groupBy("department").agg(F.count(F.lit(1)).alias("members"), best["pid"].alias("most_active"), least["pid"].alias("least_active"))
    modal = own.groupBy("department", "party").count().groupBy("department").agg(F.max(F.struct("count", "party"))["party"].alias("modal_party"))
    return counted.join(modal, "department")


def a15_trend(spark, sf_dir):
    """Trend of each group: the last four weeks against the four before."""
    own = said(spark, sf_dir).where("party <> '' and day is not null")
    last = own.agg(F.max("day").alias("d")).first()["d"]
    monday = F.date_trunc("week", F.lit(last).cast("date")).cast("date")
    recent = F.sum(F.when(F.col("day") >= F.date_sub(monday, 21), 1).otherwise(0))
    before = F.sum(F.when((F.col("day") >= F.date_sub(monday, 49)) & (F.col("day") < F.date_sub(monday, 21)), 1).otherwise(0))
    counted = own.groupBy("party").agg(recent.alias("recent"), before.alias("previous"), F.countDistinct(iso_week(F.col("day"))).alias("weeks"), F.min_by("pid", F.struct("day", "sid")).alias("opener"))
    return counted.withColumn("trend", facts.trend(F.col("recent"), F.col("previous")))


def a13_topic_shares(spark, sf_dir):
    """Labelled speeches of each group by every subject, zeros included, with the share."""
    names = sorted(r[0] for r in table(spark, sf_dir, "domains", "domain_id").where("domain_id is not null").distinct().collect())  # a fixed list
    own = said(spark, sf_dir).join(table(spark, sf_dir, "topic_labels").where("domain_id is not null").distinct(), "sid").where("party <> ''")
    dense = facts.dense_counts(own, ["party"], "domain_id", names, "speeches")
    return dense.withColumn("share", F.round(share_of("speeches", F.sum("speeches").over(Window.partitionBy("party"))), 9))


def x9_lift(spark, sf_dir):
    """Share of each group in each subject over its share in all, with the group that owns the subject."""
    own = said(spark, sf_dir).join(table(spark, sf_dir, "topic_labels").where("domain_id is not null").distinct(), "sid").where("party <> ''")
    counted = own.groupBy("domain_id", "party").agg(F.count(F.lit(1)).alias("n"))
    overall = counted.groupBy("party").agg(F.sum("n").alias("_p"))
    whole = counted.agg(F.sum("n")).first()[0] or 1
    share = F.col("n") / F.sum("n").over(Window.partitionBy("domain_id"))
    rated = counted.join(overall, "party").withColumn("lift", F.round(lift(share, F.col("_p") / F.lit(whole)), 9))
    return top_k(rated.select("domain_id", "party", "n", "lift"), ["domain_id"], [F.desc("lift"), F.asc("party")], 3)


def a22_latest_seat(spark, sf_dir):
    """The seat of each person: the open one, else the latest."""
    own = table(spark, sf_dir, "seats").withColumn("start", day("start_date")).withColumn("open", end_day("end_date").isNull().cast("int")).where("start is not null")
    return lookups.latest(own, "acteur_id", ["open", "start"], ["department", "constituency_no"])


def j9_group_on_day(spark, sf_dir):
    """Standing memberships that contain each speech's day, by interval join; the earliest start wins."""
    folk = people(spark, sf_dir).select("pid", "acteur_id")
    own = said(spark, sf_dir).where("pid is not null").join(broadcast_if_small(folk), "pid").select("sid", "acteur_id", "day")
    spans = standing(table(spark, sf_dir, "memberships")).where("start_date is not null")
    return lookups.containing(own, spans, "acteur_id", "day", "start_date", "end_date").groupBy("sid").agg(F.count(F.lit(1)).alias("spans"), F.min("start_date").cast("string").alias("first_start"))


def _next_aside(spark, sf_dir, own):
    folk = people(spark, sf_dir).select("pid", "acteur_id")
    events = own.where("pid is not null").join(broadcast_if_small(folk), "pid").select("sid", "acteur_id", "day")
    later = asides(spark, sf_dir).where("record_type = 'reaction' and acteur_id <> ''").select("acteur_id", F.col("day").alias("reaction_day"), "aside_id")
    return lookups.next_after(events, later, ["acteur_id"], "day", "reaction_day", ["aside_id"]).select("sid", F.col("day").cast("string").alias("day"), F.col("reaction_day").cast("string").alias("reaction_day"), "aside_id", F.datediff("reaction_day", "day").alias("gap_days"))


def j7_next_aside(spark, sf_dir):
    """Each labelled speech with the speaker's first reaction on or after its day."""
    return _next_aside(spark, sf_dir, said(spark, sf_dir).join(table(spark, sf_dir, "topic_labels", "sid").distinct(), "sid", "left_semi"))


def j7_next_aside_all(spark, sf_dir):
    """Every speech with the speaker's first reaction on or after its day."""
    return _next_aside(spark, sf_dir, said(spark, sf_dir))


def j13_title_match(spark, sf_dir):
    """The longest keyword of the subjects that stands in each debate title."""
    needles = [r[0] for r in table(spark, sf_dir, "domains").select(F.explode("keywords").alias("k")).select(fold("k")).distinct().collect()]  # a fixed list
    titles = said(spark, sf_dir, "debate_title").where("debate_title <> ''").select("debate_title", fold("debate_title").alias("folded")).distinct()
    return lookups.longest_contained(titles, "debate_title", "folded", needles, "keyword")


def j14_guarded(spark, sf_dir):
    """Bill numbers whose two titles in one speech share two words or more."""
    own = said(spark, sf_dir, "debate_title", "dossier_title", "bill_number").where("bill_number <> ''")
    a, b = fold(F.coalesce("debate_title", F.lit(""))), fold(F.coalesce("dossier_title", F.lit("")))
    return own.where((a != "") & (b != "") & lookups.shared_words(a, b, 2)).groupBy("bill_number").agg(F.count(F.lit(1)).alias("speeches"))


def j16_same_groups(spark, sf_dir):
    """Sittings in which exactly the same groups spoke."""
    own = said(spark, sf_dir).where("party <> ''")
    sets = lookups.same_set(own, ["session_uid"], "party")
    return sets.groupBy(F.concat_ws(",", "members").alias("groups")).agg(F.count(F.lit(1)).alias("sittings"), F.min("session_uid").alias("first_sitting"))


def a23_subjects(spark, sf_dir):
    """The first five distinct debate titles of each person, in order of speech."""
    own = said(spark, sf_dir, "debate_title").where("pid is not null and debate_title <> ''")
    return facts.first_distinct(own, "pid", "debate_title", "sid", 5).select("pid", F.concat_ws(" | ", "values").alias("titles"))


def a25_kinds(spark, sf_dir):
    """The fourteen most common asides of each kind, with rates."""
    own = asides(spark, sf_dir).where("norm <> ''").groupBy("record_type", "norm").agg(F.count(F.lit(1)).alias("count"), F.countDistinct("session_uid").alias("sittings"))
    whole = Window.partitionBy("record_type")
    rated = own.withColumn("per_thousand", F.round(rate_per_thousand(F.col("count"), F.sum("count").over(whole)), 9))
    return top_k(rated, ["record_type"], [F.desc("count"), F.asc("norm")], 14)


def a26_metrics(spark, sf_dir):
    """Least, most and mean of the numbers of speeches."""
    own = said(spark, sf_dir, "words", "tokens").withColumn("words", F.col("words").cast("double")).withColumn("tokens", F.col("tokens").cast("double"))
    return facts.summary(own, ["words", "tokens"]).withColumn("mean", F.round("mean", 9))


def a27_givers(spark, sf_dir):
    """Applause that each group gave, and how much went to members of other groups."""
    own = asides(spark, sf_dir).where("record_type = 'reaction' and kind = 'applaudissement' and acteur_id <> ''")
    given = own.select("acteur_id", F.explode(F.array_distinct("group_codes")).alias("giver")).where("giver <> ''")
    joined = given.join(people(spark, sf_dir).select("acteur_id", "party"), "acteur_id")
    counted = joined.groupBy("giver").agg(F.count(F.lit(1)).alias("given"), F.sum((F.col("party") != F.col("giver")).cast("int")).alias("to_others"))
    return counted.withColumn("share", F.round(share_of("to_others", "given"), 9))


def a28_precision(spark, sf_dir):
    """How well keywords in titles and in contents name the labelled subject."""
    words = table(spark, sf_dir, "domains").select("domain_id", F.explode("keywords").alias("k")).select("domain_id", fold("k").alias("k")).collect()  # a fixed list
    labels = table(spark, sf_dir, "topic_labels").where("domain_id is not null").groupBy("sid").agg(F.collect_set("domain_id").alias("_l"))
    own = said(spark, sf_dir, "debate_title", "content").join(labels, "sid")
    texts = {"title": fold(F.coalesce("debate_title", F.lit(""))), "text": fold(F.array_join(F.coalesce("content", F.array().cast("array<string>")), " "))}
    found = None
    for method, text in texts.items():
        named = F.coalesce(*[F.when(contains_phrase("_t", F.lit(r["k"])), r["domain_id"]) for r in sorted(words)])
        part = own.withColumn("_t", text).select(F.lit(method).alias("method"), named.alias("_d"), "_l").where("_d is not null").select("method", F.array_contains("_l", F.col("_d")).cast("int").alias("right"))
        found = part if found is None else found.unionByName(part)
    return facts.precision_by(found, "method", "right").select("method", "judged", F.round("precision", 9).alias("precision"), F.round("weight", 9).alias("weight"))


def a30_sample(spark, sf_dir):
    """Five speeches of each group for judging, the same for a seed."""
    own = said(spark, sf_dir).where("party <> ''").select("party", "sid")
    return facts.stratified_sample(own, "party", "sid", 5, 42)


def t2_titles(spark, sf_dir):
    """Debate titles folded, as slug, as file name, and without accents."""
    own = said(spark, sf_dir, "debate_title").where("debate_title <> ''").select("debate_title").distinct()
    return own.select("debate_title", fold("debate_title").alias("folded"), slug("debate_title").alias("slug"), safe_name("debate_title").alias("file"), fold_punctuated("debate_title").alias("bare"))


def t6_person_ids(spark, sf_dir):
    """Identifiers of people from name and group."""
    name = F.regexp_replace("full_name", r"^(M\.|Mme)\s+", "")
    return people(spark, sf_dir).select("pid", person_slug(name, "party").alias("slug"))


def t13_documents(spark, sf_dir):
    """Sentences and paragraphs of documents, and their first paragraph shortened to 120 characters."""
    own = table(spark, sf_dir, "documents", "doc_id", "text").where("text is not null")
    parts = paragraphs("text")
    return own.select("doc_id", F.size(sentences("text")).alias("sentences"), F.size(parts).alias("paragraphs"), shortened(F.coalesce(F.try_element_at(parts, F.lit(1)), F.lit("")), 120).alias("head"))


def t20_days(spark, sf_dir):
    """Days in all spellings with month, ISO week and Monday."""
    own = table(spark, sf_dir, "speeches", "speech_date").distinct().withColumn("d", day("speech_date"))
    return own.select("speech_date", F.col("d").cast("string").alias("day"), F.date_format("d", "yyyy-MM").alias("month"), iso_week(F.col("d")).alias("week"), F.date_trunc("week", "d").cast("date").cast("string").alias("monday"))


_SEATS = f"seat AS (SELECT *, {day_sql('start_date')} AS s, coalesce({day_sql('end_date')}, DATE '9999-12-31') AS e FROM seats)"
_CHAMBER = f"""WITH {SAID}, {ASIDES}, cut AS (SELECT aside.*, pid FROM aside JOIN politicians USING (acteur_id) WHERE record_type = 'interruption' AND acteur_id <> ''),
present AS (SELECT pid, count(*) AS sittings FROM (SELECT pid, session_uid FROM said WHERE pid IS NOT NULL UNION SELECT pid, session_uid FROM cut) GROUP BY pid),
spoke AS (SELECT pid, count(*) AS speeches, sum(words)::BIGINT AS words FROM said WHERE pid IS NOT NULL GROUP BY pid), heckled AS (SELECT pid, count(*) AS interruptions FROM cut GROUP BY pid),
chamber AS (SELECT pid, sittings, coalesce(speeches, 0) AS speeches, coalesce(words, 0)::BIGINT AS words, coalesce(interruptions, 0) AS interruptions FROM present LEFT JOIN spoke USING (pid) LEFT JOIN heckled USING (pid)) """
_LABELLED = f"WITH {SAID}, lab AS (SELECT DISTINCT sid, domain_id FROM topic_labels WHERE domain_id IS NOT NULL), own AS (SELECT said.*, domain_id FROM said JOIN lab USING (sid) WHERE party <> '') "
_STANDING = f"""m AS (SELECT acteur_id, s, e FROM (SELECT acteur_id, {day_sql("start_date")} AS s, coalesce({day_sql("end_date")}, DATE '9999-12-31') AS e,
row_number() OVER (PARTITION BY acteur_id, coalesce(party, ''), {day_sql("start_date")} ORDER BY {day_sql("known_on")} DESC NULLS LAST, coalesce({day_sql("end_date")}, DATE '9999-12-31') DESC) AS r FROM memberships) WHERE r = 1 AND s IS NOT NULL)"""
_NBSP = "  "

def _greedy_sql() -> str:
    """Six picks of each sitting, one after the other, each the best that shares nothing with those before."""
    steps = [f"""WITH {SAID}, o AS (SELECT session_uid, party, pid, -words AS order_words, sid FROM said WHERE pid IS NOT NULL AND words IS NOT NULL), p0 AS (SELECT *, 0 AS pick FROM o WHERE false)"""]
    for k in range(1, 7):
        steps.append(f"""p{k} AS (SELECT * FROM p{k - 1} UNION ALL SELECT session_uid, party, pid, order_words, sid, {k} FROM (SELECT *, row_number() OVER (PARTITION BY session_uid ORDER BY order_words, sid) AS r FROM o
        WHERE NOT EXISTS (SELECT 1 FROM p{k - 1} q WHERE q.session_uid = o.session_uid AND (q.party = o.party OR q.pid = o.pid))) WHERE r = 1)""")
    return ", ".join(steps) + " SELECT * FROM p6"


_GREEDY = _greedy_sql()
_ALL = {
    "v6_chamber": (v6_chamber, _CHAMBER + "SELECT * FROM chamber"),
    "w2_peer_ranks": (w2_peer_ranks, _CHAMBER + """, r AS (SELECT pid, coalesce(party, '') AS party, round(interruptions / sittings, 9) AS rate FROM chamber JOIN politicians USING (pid) WHERE sittings >= 3),
        w AS (SELECT *, rank() OVER (PARTITION BY party ORDER BY rate) - 1 AS lo, rank() OVER (PARTITION BY party ORDER BY rate DESC) - 1 AS hi, count(*) OVER (PARTITION BY party) AS pool FROM r)
        SELECT pid, party, rate, CASE WHEN pool >= 2 THEN lo END AS lower, CASE WHEN pool >= 2 THEN hi END AS higher, pool FROM w"""),
    "w3_more_active": (w3_more_active, f"""WITH {SAID}, e AS (SELECT p.pid, coalesce(p.party, '') AS party, count(s.sid) AS speeches FROM politicians p LEFT JOIN said s ON s.pid = p.pid GROUP BY ALL),
        w AS (SELECT *, rank() OVER (PARTITION BY party ORDER BY speeches) - 1 AS lo, count(*) OVER (PARTITION BY party) AS n FROM e) SELECT pid, party, speeches, CASE WHEN n >= 2 THEN round(lo / n, 9) END AS more_active_than FROM w"""),
    "w4_quantiles": (w4_quantiles, f"""WITH {SAID}, l AS (SELECT party, list_sort(list(words::BIGINT)) AS v, median(words) AS median, quantile_cont(words, 0.9) AS q, avg(words) AS mean FROM said WHERE party <> '' AND words IS NOT NULL GROUP BY party)
        SELECT party, median::DOUBLE AS median, v[floor(0.9 * (len(v) - 1) + 0.5)::INT + 1] AS nearest, round(q, 9) AS interpolated, v[least(floor(0.1 * len(v))::INT, len(v) - 1) + 1] AS floor, round(mean, 9) AS mean FROM l"""),
    "w8_favourites": (w8_favourites, f"""WITH {ASIDES}, own AS (SELECT * FROM aside WHERE record_type = 'interruption' AND acteur_id <> '' AND norm <> ''), t AS (SELECT count(*) AS whole FROM own), a AS (SELECT acteur_id, count(*) AS mine FROM own GROUP BY 1), l AS (SELECT norm, count(*) AS line FROM own GROUP BY 1),
        c AS (SELECT acteur_id, norm, count(*) AS count, count(DISTINCT session_uid) AS sittings, arg_max(quote, (coalesce(day, DATE '0001-01-01'), aside_id)) AS quote FROM own GROUP BY ALL HAVING count(*) >= 3 AND count(DISTINCT session_uid) >= 3),
        j AS (SELECT c.*, line - count AS rest, mine, whole FROM c JOIN a USING (acteur_id) JOIN l USING (norm), t),
        r AS (SELECT acteur_id, norm, count, sittings, rest, quote, row_number() OVER (PARTITION BY acteur_id ORDER BY count DESC, sittings DESC, quote)::INTEGER AS rank_no FROM j WHERE rest = 0 OR count / mine >= 2 * (rest / (whole - mine)))
        SELECT * FROM r WHERE rank_no <= 5"""),
    "w9_moments": (w9_moments, f"""WITH {ASIDES}, own AS (SELECT acteur_id, aside_id, norm, day, CASE WHEN every_bench = 1 THEN 5 ELSE greatest(len(list_distinct(coalesce(group_codes, []))), coalesce(unnamed_benches, 0)) END AS camps FROM aside WHERE record_type = 'reaction' AND kind = 'applaudissement' AND acteur_id <> '' AND norm <> ''),
        a AS (SELECT *, row_number() OVER (PARTITION BY acteur_id ORDER BY camps DESC, day DESC, aside_id) AS r FROM own), b AS (SELECT *, row_number() OVER (PARTITION BY acteur_id, norm ORDER BY r) AS o FROM a WHERE r <= 60),
        c AS (SELECT acteur_id, aside_id, norm, camps::INTEGER AS camps, row_number() OVER (PARTITION BY acteur_id ORDER BY r)::INTEGER AS rank_no FROM b WHERE o = 1 AND len(string_split(norm, ' ')) >= 6) SELECT * FROM c WHERE rank_no <= 3"""),
    "w10_diverse": (w10_diverse, f"""WITH {SAID}, own AS (SELECT debate_title, party, sid, day, words FROM said WHERE debate_title <> '' AND words >= 80), a AS (SELECT *, row_number() OVER (PARTITION BY debate_title, party ORDER BY day DESC, sid) AS w FROM own),
        b AS (SELECT debate_title, party, sid, day, words, row_number() OVER (PARTITION BY debate_title ORDER BY (w > 1)::INT, day DESC, sid)::INTEGER AS pick FROM a) SELECT * FROM b WHERE pick <= 6"""),
    "w11_greedy": (w11_greedy, _GREEDY),
    "w13_leaders": (w13_leaders, _CHAMBER + """, o AS (SELECT pid, sittings, interruptions, round(interruptions / sittings, 9) AS per_sitting FROM chamber WHERE interruptions > 0)
        (SELECT 'sitting' AS list, * FROM o ORDER BY per_sitting DESC, interruptions DESC, pid LIMIT 10) UNION ALL (SELECT 'total', * FROM o ORDER BY interruptions DESC, per_sitting DESC, pid LIMIT 10)"""),
    "w18_remainder": (w18_remainder, """WITH c AS (SELECT department, constituency_no, count(*) AS mandates FROM seats WHERE department <> '' AND constituency_no IS NOT NULL GROUP BY ALL),
        x AS (SELECT *, 50 * mandates / sum(mandates) OVER (PARTITION BY department) AS x FROM c), f AS (SELECT *, floor(x) AS f, 50 - sum(floor(x)) OVER (PARTITION BY department) AS remaining FROM x),
        r AS (SELECT *, row_number() OVER (PARTITION BY department ORDER BY x - f DESC, constituency_no) AS r FROM f) SELECT department, constituency_no, mandates, (f + (r <= remaining)::INT)::BIGINT AS allotted FROM r"""),
    "w19_place_search": (w19_place_search, f"""WITH c AS (SELECT department, department_name, count(*) AS mandates, {fold_sql("department_name")} AS k FROM seats WHERE department_name <> '' GROUP BY ALL), q AS (SELECT unnest({list(SEARCHES)}) AS search),
        s AS (SELECT department, department_name, mandates, search, CASE WHEN k = search THEN 0 WHEN starts_with(k, search) THEN 1 WHEN contains(' ' || k, ' ' || search) THEN 2 WHEN contains(k, search) THEN 3 END AS score FROM c, q),
        r AS (SELECT *, row_number() OVER (PARTITION BY search ORDER BY score, length(department_name), department_name, department)::INTEGER AS rank_no FROM s WHERE score IS NOT NULL) SELECT * FROM r WHERE rank_no <= 8"""),
    "w21_angles": (w21_angles, f"""WITH {SAID}, {_SEATS}, l AS (SELECT acteur_id, arg_max(department, (s, department)) AS department FROM seat WHERE s IS NOT NULL AND department <> '' GROUP BY 1),
        o AS (SELECT department, p.pid, coalesce(p.party, '') AS party, count(sid) AS speeches FROM politicians p JOIN l USING (acteur_id) LEFT JOIN said ON said.pid = p.pid GROUP BY ALL),
        m AS (SELECT department, arg_max(party, (n, party)) AS modal_party FROM (SELECT department, party, count(*) AS n FROM o GROUP BY ALL) GROUP BY 1)
        SELECT department, count(*) AS members, arg_max(pid, (speeches, pid)) AS most_active, arg_min(pid, (speeches, pid)) AS least_active, any_value(modal_party) AS modal_party FROM o JOIN m USING (department) GROUP BY department"""),
    "a15_trend": (a15_trend, f"""WITH {SAID}, own AS (SELECT * FROM said WHERE party <> '' AND day IS NOT NULL), w AS (SELECT date_trunc('week', max(day))::DATE AS m FROM own),
        c AS (SELECT party, sum((day >= m - 21)::INT)::BIGINT AS recent, sum((day >= m - 49 AND day < m - 21)::INT)::BIGINT AS previous, count(DISTINCT strftime(day, '%G-W%V')) AS weeks, arg_min(coalesce(pid, -1), (day, sid)) AS opener FROM own, w GROUP BY party)
        SELECT * REPLACE (CASE WHEN opener >= 0 THEN opener END AS opener), CASE WHEN previous = 0 AND recent > 0 THEN 'new' WHEN recent > previous * 1.2 THEN 'rising' WHEN recent < previous * 0.8 THEN 'falling' ELSE 'stable' END AS trend FROM c"""),
    "a13_topic_shares": (a13_topic_shares, _LABELLED + """, g AS (SELECT DISTINCT party FROM own), d AS (SELECT DISTINCT domain_id FROM domains), n AS (SELECT party, domain_id, count(*) AS n FROM own GROUP BY ALL),
        e AS (SELECT g.party, d.domain_id, coalesce(n, 0) AS speeches FROM g CROSS JOIN d LEFT JOIN n ON n.party = g.party AND n.domain_id = d.domain_id) SELECT *, round(speeches / sum(speeches) OVER (PARTITION BY party), 9) AS share FROM e"""),
    "x9_lift": (x9_lift, _LABELLED + """, n AS (SELECT domain_id, party, count(*) AS n FROM own GROUP BY ALL), s AS (SELECT domain_id, party, n, round((n / sum(n) OVER (PARTITION BY domain_id)) / (sum(n) OVER (PARTITION BY party) / sum(n) OVER ()), 9) AS lift FROM n),
        r AS (SELECT *, row_number() OVER (PARTITION BY domain_id ORDER BY lift DESC, party)::INTEGER AS rank_no FROM s) SELECT * FROM r WHERE rank_no <= 3"""),
    "a22_latest_seat": (a22_latest_seat, f"WITH {_SEATS}, r AS (SELECT *, row_number() OVER (PARTITION BY acteur_id ORDER BY (e = DATE '9999-12-31')::INT DESC, s DESC, department DESC NULLS LAST, constituency_no DESC NULLS LAST) AS r FROM seat WHERE s IS NOT NULL) SELECT acteur_id, department, constituency_no FROM r WHERE r = 1"),
    "j9_group_on_day": (j9_group_on_day, f"WITH {SAID}, {_STANDING} SELECT sid, count(*) AS spans, min(s)::VARCHAR AS first_start FROM said JOIN politicians p ON p.pid = said.pid JOIN m ON m.acteur_id = p.acteur_id AND m.s <= day AND day <= m.e GROUP BY sid"),
    "j7_next_aside": (j7_next_aside, f"""WITH {SAID}, {ASIDES}, own AS (SELECT sid, p.acteur_id, day FROM said JOIN politicians p ON p.pid = said.pid WHERE sid IN (SELECT sid FROM topic_labels)),
        r AS (SELECT sid, own.day, a.day AS reaction_day, aside_id, row_number() OVER (PARTITION BY sid ORDER BY a.day, aside_id) AS r FROM own JOIN aside a ON a.acteur_id = own.acteur_id AND record_type = 'reaction' AND a.day >= own.day)
        SELECT sid, day::VARCHAR AS day, reaction_day::VARCHAR AS reaction_day, aside_id, date_diff('day', day, reaction_day)::INTEGER AS gap_days FROM r WHERE r = 1"""),
    "j7_next_aside_all": (j7_next_aside_all, f"""WITH {SAID}, {ASIDES}, own AS (SELECT sid, p.acteur_id, day FROM said JOIN politicians p ON p.pid = said.pid),
        r AS (SELECT sid, own.day, a.day AS reaction_day, aside_id, row_number() OVER (PARTITION BY sid ORDER BY a.day, aside_id) AS r FROM own JOIN aside a ON a.acteur_id = own.acteur_id AND record_type = 'reaction' AND a.day >= own.day)
        SELECT sid, day::VARCHAR AS day, reaction_day::VARCHAR AS reaction_day, aside_id, date_diff('day', day, reaction_day)::INTEGER AS gap_days FROM r WHERE r = 1"""),
    "j13_title_match": (j13_title_match, f"""WITH {SAID}, t AS (SELECT DISTINCT debate_title, {fold_sql("debate_title")} AS f FROM said WHERE debate_title <> ''), k AS (SELECT DISTINCT {fold_sql("w")} AS keyword FROM (SELECT unnest(keywords) AS w FROM domains)),
        r AS (SELECT debate_title, keyword, row_number() OVER (PARTITION BY debate_title ORDER BY length(keyword) DESC, keyword) AS r FROM t JOIN k ON contains(' ' || f || ' ', ' ' || keyword || ' ')) SELECT debate_title, keyword FROM r WHERE r = 1"""),
    "j14_guarded": (j14_guarded, f"""WITH {SAID}, t AS (SELECT bill_number, {fold_sql("coalesce(debate_title, '')")} AS a, {fold_sql("coalesce(dossier_title, '')")} AS b FROM said WHERE bill_number <> '')
        SELECT bill_number, count(*) AS speeches FROM t WHERE a <> '' AND b <> '' AND len(list_intersect(list_distinct(string_split(a, ' ')), list_distinct(string_split(b, ' ')))) >= 2 GROUP BY 1"""),
    "j16_same_groups": (j16_same_groups, f"WITH {SAID}, s AS (SELECT session_uid, array_to_string(list_sort(list(DISTINCT party)), ',') AS groups FROM said WHERE party <> '' GROUP BY 1) SELECT groups, count(*) AS sittings, min(session_uid) AS first_sitting FROM s GROUP BY 1"),
    "a23_subjects": (a23_subjects, f"""WITH {SAID}, f AS (SELECT pid, debate_title, min(sid) AS place FROM said WHERE pid IS NOT NULL AND debate_title <> '' GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY place, debate_title) AS r FROM f)
        SELECT pid, string_agg(debate_title, ' | ' ORDER BY r) AS titles FROM r WHERE r <= 5 GROUP BY pid"""),
    "a25_kinds": (a25_kinds, f"""WITH {ASIDES}, c AS (SELECT record_type, norm, count(*) AS count, count(DISTINCT session_uid) AS sittings FROM aside WHERE norm <> '' GROUP BY ALL),
        r AS (SELECT *, round(count * 1000.0 / sum(count) OVER (PARTITION BY record_type), 9) AS per_thousand, row_number() OVER (PARTITION BY record_type ORDER BY count DESC, norm)::INTEGER AS rank_no FROM c) SELECT * FROM r WHERE rank_no <= 14"""),
    "a26_metrics": (a26_metrics, f"WITH {SAID} SELECT 'words' AS metric, min(words)::DOUBLE AS least, max(words)::DOUBLE AS most, round(avg(words), 9) AS mean FROM said UNION ALL SELECT 'tokens', min(n_tokens), max(n_tokens), round(avg(n_tokens), 9) FROM said"),
    "a27_givers": (a27_givers, f"""WITH {ASIDES}, g AS (SELECT acteur_id, unnest(list_distinct(group_codes)) AS giver FROM aside WHERE record_type = 'reaction' AND kind = 'applaudissement' AND acteur_id <> ''),
        c AS (SELECT giver, count(*) AS given, sum((coalesce(party, '') <> giver)::INT)::BIGINT AS to_others FROM g JOIN politicians USING (acteur_id) WHERE giver <> '' GROUP BY giver) SELECT *, round(to_others / given, 9) AS share FROM c"""),
    "a28_precision": (a28_precision, f"""WITH {SAID}, k AS (SELECT domain_id, {fold_sql("w")} AS k FROM (SELECT domain_id, unnest(keywords) AS w FROM domains)), lab AS (SELECT sid, list(DISTINCT domain_id) AS l FROM topic_labels WHERE domain_id IS NOT NULL GROUP BY sid),
        t AS (SELECT sid, 'title' AS method, {fold_sql("coalesce(debate_title, '')")} AS t, l FROM said JOIN lab USING (sid) UNION ALL SELECT sid, 'text', {fold_sql("coalesce(array_to_string(content, ' '), '')")}, l FROM said JOIN lab USING (sid)),
        m AS (SELECT sid, method, any_value(l) AS l, arg_min(domain_id, (domain_id, k)) AS d FROM t JOIN k ON contains(' ' || t || ' ', ' ' || k || ' ') GROUP BY sid, method), r AS (SELECT method, list_contains(l, d)::INT AS hit FROM m)
        SELECT method, count(*) AS judged, round(avg(hit), 9) AS precision, round(count(*) / (SELECT count(*) FROM r), 9) AS weight FROM r GROUP BY method"""),
    "a30_sample": (a30_sample, f"WITH {SAID}, r AS (SELECT party, sid, row_number() OVER (PARTITION BY party ORDER BY md5('42:' || sid::VARCHAR), sid) AS r FROM said WHERE party <> '') SELECT party, sid FROM r WHERE r <= 5"),
    "t2_titles": (t2_titles, f"""WITH {SAID}, t AS (SELECT DISTINCT debate_title, {fold_sql("debate_title")} AS folded FROM said WHERE debate_title <> '')
        SELECT debate_title, folded, replace(folded, ' ', '-') AS slug, regexp_replace(regexp_replace(strip_accents(debate_title), '[^A-Za-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS file, trim(strip_accents(lower(debate_title))) AS bare FROM t"""),
    "t6_person_ids": (t6_person_ids, f"""WITH t AS (SELECT pid, replace({fold_sql("regexp_replace(full_name, '^(M.|Mme) +', '')")}, ' ', '-') AS n, replace({fold_sql("coalesce(party, '')")}, ' ', '-') AS g FROM politicians) SELECT pid, CASE WHEN g <> '' THEN n || '--' || g ELSE n END AS slug FROM t"""),
    "t13_documents": (t13_documents, f"""WITH d AS (SELECT doc_id, text, list_filter(list_transform(string_split(text, chr(10)), lambda p: trim(regexp_replace(p, '\\s+', ' ', 'g'))), lambda p: p <> '') AS p,
        list_filter(list_transform(string_split(regexp_replace(text, '([.!?…])[ \\t{_NBSP}]+([A-ZÀ-ÖØ-Ý«])', '\\1' || chr(10) || '\\2', 'g'), chr(10)), lambda s: trim(s)), lambda s: s <> '') AS s FROM documents WHERE text IS NOT NULL), h AS (SELECT *, coalesce(p[1], '') AS f FROM d),
        c AS (SELECT *, substr(f, 1, 120) AS c FROM h)
        SELECT doc_id, len(s)::INTEGER AS sentences, len(p)::INTEGER AS paragraphs, CASE WHEN length(f) <= 120 THEN f WHEN length(regexp_extract(c, '(?s)^(.*[.?!]) ', 1)) > 60 THEN regexp_extract(c, '(?s)^(.*[.?!]) ', 1) ELSE regexp_replace(c, '(?s) [^ ]*$', '') || '…' END AS head FROM c"""),
    "t20_days": (t20_days, f"WITH d AS (SELECT DISTINCT speech_date, {day_sql('speech_date')} AS d FROM speeches) SELECT speech_date, d::VARCHAR AS day, strftime(d, '%Y-%m') AS month, strftime(d, '%G-W%V') AS week, date_trunc('week', d)::DATE::VARCHAR AS monday FROM d"),
}
QUERIES = {name: run for name, (run, _) in _ALL.items()}
SQL = {name: sql for name, (_, sql) in _ALL.items() if sql}
