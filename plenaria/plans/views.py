"""Composite views, each for all of its subjects at once."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from plenaria.functions import speech
from plenaria.functions.text import fold, iso_week, paragraphs, rate_per_thousand, share_of, words_only
from plenaria.operators import lookups, ranks, topics
from plenaria.operators.topk import top_k
from plenaria.plans.base import ASIDES, SAID, SPOKEN, asides, fold_sql, people, said, spoken, words_sql
from plenaria.plans.chamber import SQL as CHAMBER_SQL
from plenaria.plans.chamber import v6_chamber
from plenaria.plans.history import day_sql
from plenaria.sources.tables import day, end_day, table


def _labelled(spark, sf_dir):
    return table(spark, sf_dir, "topic_labels").where("domain_id is not null").distinct()


def v1_politicians(spark, sf_dir):
    """Each person's activity, share of all words, days, latest debate, first subject and seat."""
    own = said(spark, sf_dir, "words", "debate_title").where("pid is not null")
    whole = own.agg(F.sum("words")).first()[0] or 1
    acts = own.groupBy("pid").agg(
        F.count(F.lit(1)).alias("speeches"), F.coalesce(F.sum("words"), F.lit(0)).alias("words"), F.countDistinct("session_uid").alias("sittings"), F.min("day").cast("string").alias("first_day"), F.max("day").cast("string").alias("last_day"),
        F.max(F.struct("day", "sid", "debate_title"))["debate_title"].alias("latest_debate"),
    )
    themes = own.join(_labelled(spark, sf_dir), "sid").groupBy("pid", "domain_id").agg(F.count(F.lit(1)).alias("n"))
    first = themes.groupBy("pid").agg(F.min(F.struct((-F.col("n")).alias("n"), "domain_id"))["domain_id"].alias("subject"))
    seat = table(spark, sf_dir, "seats").withColumn("_s", day("start_date")).withColumn("_o", end_day("end_date").isNull().cast("int")).where("_s is not null")
    placed = lookups.latest(seat, "acteur_id", ["_o", "_s"], ["department"])
    joined = people(spark, sf_dir).select("pid", "id", "acteur_id", "party").join(acts, "pid", "left").join(first, "pid", "left").join(placed, "acteur_id", "left").fillna(0, ["speeches", "words", "sittings"])
    return joined.drop("acteur_id").withColumn("share", F.round(F.col("words") / F.lit(whole), 9))


def v2_parties(spark, sf_dir):
    """Each group's members, speeches, speakers, words, share and three most active speakers."""
    own = said(spark, sf_dir, "words").where("party <> ''")
    stats = own.groupBy("party").agg(F.count(F.lit(1)).alias("speeches"), F.countDistinct("pid").alias("speakers"), F.sum("words").alias("words"))
    members = people(spark, sf_dir).where("party <> ''").groupBy("party").agg(F.count(F.lit(1)).alias("members"))
    active = top_k(own.where("pid is not null").groupBy("party", "pid").agg(F.count(F.lit(1)).alias("n")), ["party"], [F.desc("n"), F.asc("pid")], 3)
    best = active.groupBy("party").agg(F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.struct("rank_no", "pid"))), lambda x: x["pid"].cast("string"))).alias("most_active"))
    whole = own.agg(F.sum("words")).first()[0] or 1
    return stats.join(members, "party", "left").join(best, "party", "left").withColumn("members", F.coalesce("members", F.lit(0))).withColumn("share", F.round(F.col("words") / F.lit(whole), 9))


def v3_themes(spark, sf_dir):
    """Each subject's speeches, people, days, weeks, opening group and leading group with its share."""
    own = said(spark, sf_dir).join(_labelled(spark, sf_dir), "sid").where("party <> ''")
    stats = own.groupBy("domain_id").agg(
        F.count(F.lit(1)).alias("speeches"), F.countDistinct("pid").alias("people"), F.min("day").cast("string").alias("first_day"), F.max("day").cast("string").alias("last_day"),
        F.countDistinct(iso_week(F.col("day"))).alias("weeks"), F.min_by("party", F.struct("day", "sid")).alias("opener"),
    )
    lead = own.groupBy("domain_id", "party").agg(F.count(F.lit(1)).alias("n")).groupBy("domain_id").agg(F.min(F.struct((-F.col("n")).alias("n"), "party")).alias("_l"))
    return stats.join(lead, "domain_id").select("*", F.col("_l.party").alias("leader"), F.round(share_of(-F.col("_l.n"), F.col("speeches")), 9).alias("leader_share")).drop("_l")


def v4_assembly(spark, sf_dir):
    """Totals of the archive in one row."""
    own = said(spark, sf_dir, "words")
    return own.agg(
        F.count(F.lit(1)).alias("speeches"), F.countDistinct("pid").alias("people"), F.countDistinct("session_uid").alias("sittings"), F.sum("words").alias("words"),
        F.countDistinct("party").alias("groups"), F.min("month").alias("first_month"), F.max("month").alias("last_month"),
    )


def v5_rankings(spark, sf_dir):
    """The ten most applauded from other groups, and the ten most protested at."""
    own = asides(spark, sf_dir).where("record_type = 'reaction' and acteur_id <> ''").join(people(spark, sf_dir).select("acteur_id", "pid", "party"), "acteur_id")
    others = F.size(F.array_except(F.coalesce("group_codes", F.array().cast("array<string>")), F.array("party")))
    wide = F.when((F.col("every_bench") == 1) | (F.col("unnamed_benches") == 1) | (others > 0), 1).otherwise(0)
    counted = own.groupBy("pid").agg(F.sum(F.when(F.col("kind") == "applaudissement", wide).otherwise(0)).alias("applauded"), F.sum(F.when(F.col("kind") == "protestation", 1).otherwise(0)).alias("protested"))
    lists = [counted.where(F.col(c) > 0).orderBy(F.desc(c), "pid").limit(10).select(F.lit(c).alias("list"), "pid", F.col(c).alias("count")) for c in ("applauded", "protested")]
    return lists[0].unionByName(lists[1])


def v7_digest(spark, sf_dir):
    """What each person did in the ninety days before the archive's last."""
    own = said(spark, sf_dir, "words")
    last = own.agg(F.max("day")).first()[0]
    return own.where((F.col("day") > F.date_sub(F.lit(last).cast("date"), 90)) & F.col("pid").isNotNull()).groupBy("pid").agg(F.count(F.lit(1)).alias("speeches"), F.sum("words").alias("words"), F.max("day").cast("string").alias("latest"))


_WORDING = {"je": ("je", "j"), "nous": ("nous",), "vous": ("vous",), "obligation": ("doit", "doivent", "devons", "devez", "faut"), "possibility": ("peut", "peuvent", "pouvons", "pouvez")}
_MEASURES = (*_WORDING, "negation")
#: From how far off the chamber's rate a group's wording stands out.
STANDS_OUT = 1.25


def q11_style(spark, sf_dir):
    """Words, and uses of six kinds of wording, by group; ``peut être`` is no possibility."""
    own = spoken(spark, sf_dir).where("party <> ''")

    def uses(key):
        if key == "negation":
            return F.sum(F.size(speech.negations(F.array_join("tokens", " "))))
        words = F.array_remove(F.split(F.regexp_replace(F.concat_ws(" ", F.array_join("tokens", " ")), r"(?<=^| )peut (?:être|etre)(?= |$)", ""), " "), "") if key == "possibility" else F.col("tokens")
        return F.sum(F.size(F.filter(words, lambda t: t.isin(list(_WORDING[key])))))

    return own.groupBy("party").agg(F.sum(F.size("tokens")).alias("words"), *[uses(k).alias(k) for k in _MEASURES])


def wording_rates(spark, sf_dir):
    """Each group's rate of every kind of wording, the chamber's, and their ratio; groups of 500 words and more."""
    long = q11_style(spark, sf_dir).select("party", "words", F.explode(F.array(*[F.struct(F.lit(k).alias("key"), F.col(k).alias("n")) for k in _MEASURES])).alias("_m")).select("party", "words", "_m.*")
    every = Window.partitionBy("key")
    rated = long.withColumn("rate", rate_per_thousand("n", "words")).withColumn("chamber", rate_per_thousand(F.sum("n").over(every), F.sum("words").over(every)))
    return rated.where("words >= 500 and chamber > 0").select("party", "key", F.round("rate", 9).alias("rate"), F.round("chamber", 9).alias("chamber"), F.round(F.col("rate") / F.col("chamber"), 9).alias("ratio"))


def v10_wording(spark, sf_dir):
    """Kinds of wording in which a group is a quarter off the chamber, the three largest gaps first."""
    out = wording_rates(spark, sf_dir).where((F.col("ratio") >= STANDS_OUT) | (F.col("ratio") <= 1 / STANDS_OUT))
    return top_k(out, ["party"], [F.desc(F.abs(F.ln(F.greatest("ratio", F.lit(1e-6))))), F.asc("key")], 3)


def v17_people(spark, sf_dir):
    """Each group's people as one JSON list, by surname, with their speeches."""
    acts = said(spark, sf_dir).where("pid is not null").groupBy("pid").agg(F.count(F.lit(1)).alias("speeches"))
    own = people(spark, sf_dir).where("party <> ''").join(acts, "pid", "left").fillna(0, ["speeches"]).withColumn("surname", F.regexp_extract("full_name", r"(\S+)$", 1))
    listed = F.array_sort(F.collect_list(F.struct("surname", "pid", "speeches")))
    return own.groupBy("party").agg(F.count(F.lit(1)).alias("people"), F.concat_ws(";", F.transform(listed, lambda x: F.concat_ws(":", x["surname"], x["pid"].cast("string"), x["speeches"].cast("string")))).alias("listed"))


def v18_places(spark, sf_dir):
    """Departments with the constituencies and names seen under each code; codes that share a name inherit its numbers."""
    own = table(spark, sf_dir, "seats").where("department <> ''")
    named = own.where("department_name <> ''").groupBy("department_name").agg(F.array_sort(F.collect_set("constituency_no")).alias("_all"))
    codes = own.groupBy("department").agg(F.array_sort(F.collect_set("constituency_no")).alias("numbers"), F.max("department_name").alias("department_name"))
    joined = codes.join(named, "department_name", "left")
    return joined.select("department", "department_name", F.size("numbers").alias("own"), F.size(F.array_union("numbers", F.coalesce("_all", F.array().cast("array<int>")))).alias("inherited"))


def q12_markers(spark, sf_dir):
    """Negations, forms of address and the kind of marker in each aside."""
    own = asides(spark, sf_dir).select("aside_id", words_only(F.coalesce("quote", F.lit(""))).alias("w"))
    return own.select("aside_id", F.size(speech.negations("w")).alias("negations"), F.size(speech.addresses("w")).alias("addresses"), speech.marker_kind(F.split("w", " ")).alias("kind"))


def q16_mentions(spark, sf_dir):
    """Who is named in the raw lines of each sitting, and how often."""
    words = F.split("full_name", " ")
    folk = table(spark, sf_dir, "politicians", "pid", "full_name").where("full_name is not null").select("pid", words[0].alias("civility"), words[1].alias("first"), F.array_join(F.slice(words, 3, 9), " ").alias("last"))
    lines = table(spark, sf_dir, "transcript_lines", "session_uid", "line_no", "raw_text").dropDuplicates(["session_uid", "line_no"])
    texts = lines.select(F.concat_ws(" ", "session_uid", "line_no").alias("line"), F.lit(None).cast("bigint").alias("speaker"), F.col("raw_text").alias("text"))
    found = speech.with_mentions(texts, "line", "text", "speaker", folk)
    return found.groupBy(F.split("line", " ")[0].alias("session_uid"), "target").agg(F.count(F.lit(1)).alias("mentions"))


def q20_text_themes(spark, sf_dir):
    """Subjects that speeches are about by the rules on the subjects' expressions."""
    words = table(spark, sf_dir, "domains").select("domain_id", F.explode("keywords").alias("k")).select("domain_id", fold("k").alias("k")).collect()  # a fixed list
    rules = [speech.Rule(r["domain_id"], r["k"]) for r in words]
    texts = said(spark, sf_dir, "content").select("sid", fold(F.array_join(F.coalesce("content", F.array().cast("array<string>")), " ")).alias("t"))
    return speech.with_text_themes(texts, "sid", "t", rules).select("sid", "theme", "hits", F.concat_ws(",", "phrases").alias("phrases"))


def t16_best_paragraph(spark, sf_dir):
    """The paragraph of each document that holds most of ``loi``, ``article`` and ``groupe``; longer ones, then earlier ones first."""
    own = table(spark, sf_dir, "documents", "doc_id", "text").where("text is not null")
    each = own.select("doc_id", F.posexplode(paragraphs("text")).alias("pos", "p")).withColumn("f", F.concat(F.lit(" "), fold("p"), F.lit(" ")))
    hits = sum(F.regexp_count("f", F.lit(f" {w}(?= )")) for w in ("loi", "article", "groupe"))
    best = each.withColumn("hits", hits).groupBy("doc_id").agg(F.max(F.struct("hits", F.least(F.length("p"), F.lit(600)).alias("n"), (-F.col("pos")).alias("at"))).alias("_b"))
    return best.select("doc_id", F.col("_b.hits").alias("hits"), (-F.col("_b.at")).alias("pos"))


def x5_tfidf_rows(spark, sf_dir):
    """TF-IDF rows of speeches, summed by term."""
    rows = topics.tfidf_rows(spoken(spark, sf_dir).select("sid", "tokens"), "sid", "tokens")
    return rows.groupBy("term").agg(F.count(F.lit(1)).alias("documents"), F.round(F.sum("weight"), 6).alias("weight"))


def x8_topics(spark, sf_dir):
    """Main topic of each speech by non-negative matrix factorisation; null where none of the terms stands in it."""
    docs, terms = topics.tfidf_arrays(spoken(spark, sf_dir).select("sid", "tokens"), "sid", "tokens")
    weights, _ = topics.factorised(docs, "sid", terms, 15, 400)
    return weights.groupBy("sid").agg(F.min(F.struct((-F.col("weight")).alias("weight"), "topic"))["topic"].alias("topic"))


def r14_groups_in_order(spark, sf_dir):
    """Groups in order of words, with the volume at speech and the members by card."""
    own = said(spark, sf_dir, "words").where("party <> ''").groupBy("party").agg(F.sum("words").alias("words"))
    cards = people(spark, sf_dir).where("party <> ''").groupBy("party").agg(F.count(F.lit(1)).alias("members"))
    return own.join(cards, "party", "left").withColumn("place", F.row_number().over(Window.orderBy(F.desc("words"), "party"))).fillna(0, ["members"])  # one row for each group


def w5_deciles(spark, sf_dir):
    """People in the top decile of their group by interruptions for each sitting, pools of five or more."""
    own = v6_chamber(spark, sf_dir).join(people(spark, sf_dir).select("pid", "party"), "pid").withColumn("rate", F.round(F.col("interruptions") / F.col("sittings"), 9))
    edge = ranks.values_at(own, ["party"], "rate", {"_e": ranks.nearest(0.9)}).join(own.groupBy("party").agg(F.count(F.lit(1)).alias("pool")), "party")
    return own.join(edge, "party").where("pool >= 5 and rate >= _e").select("pid", "party", "rate", "pool")


def r21_statuses(spark, sf_dir):
    """Order states of every customer, those without an order included."""
    orders = table(spark, sf_dir, "orders", "o_custkey", "o_orderstatus")
    joined = table(spark, sf_dir, "customer", "c_custkey").join(orders, F.col("c_custkey") == F.col("o_custkey"), "left")
    return joined.withColumn("status", F.coalesce("o_orderstatus", F.lit("none"))).groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("c_custkey").alias("customers"))


def a17_censure(spark, sf_dir):
    """A group supports a motion that more than half its members signed: line returns as signatures."""
    items = table(spark, sf_dir, "lineitem", "l_suppkey", "l_orderkey", "l_returnflag")
    members = items.groupBy("l_suppkey").agg(F.countDistinct("l_orderkey").alias("members"), F.countDistinct(F.when(F.col("l_returnflag") == "R", F.col("l_orderkey"))).alias("signed"))
    return members.withColumn("position", F.when(F.col("signed") * 2 > F.col("members"), "pour").otherwise("contre"))


def a14_weekly_shares(spark, sf_dir):
    """Each group's share of the labelled speeches of a subject in each week."""
    own = said(spark, sf_dir).join(_labelled(spark, sf_dir), "sid").where("party <> '' and day is not null").withColumn("week", iso_week(F.col("day")))
    counted = own.groupBy("domain_id", "week", "party").agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("domain_id", "week")), 9))


_IN = lambda words: "(" + ", ".join(f"'{w}'" for w in words) + ")"
_CLOSING = ("pas", "rien", "jamais", "aucun", "plus")
_ADDRESS = f" (({'|'.join(speech.DEAR + speech.OWN)})  ({'|'.join(speech.COLLEAGUE)})|({'|'.join(speech.CIVILITY)})(  ({'|'.join(speech.ARTICLE)}))?  ({'|'.join(speech.TITLE)})) "
_PAIRS = f"list_filter(range(1, len(w) + 1), lambda i: w[i] IN ('ne', 'n') AND coalesce(list_transform(list_filter([i + 1, i + 2, i + 3, i + 4], lambda j: w[j] IN {_IN(_CLOSING)}), lambda j: w[j] <> 'plus' OR coalesce(w[j + 1], '') NOT IN {_IN(speech.COMPARATIVE)})[1], false))"
_ALONE = f"list_filter(range(1, len(w) + 1), lambda i: w[i] IN {_IN(speech.STANDALONE)} AND (i = 1 OR w[i - 1] NOT IN {_IN(speech.NOT_BEFORE_STANDALONE)}))"
_STYLE_SQL = f"WITH {SPOKEN}, o AS (SELECT party, tokens AS w FROM spoken WHERE party <> ''), w AS (SELECT party, sum(len(w))::BIGINT AS words, " + ", ".join(
    f"sum(len(list_filter({'range(1, len(w) + 1)' if k == 'possibility' else 'w'}, lambda x: " + (f"w[x] IN {_IN(ws)} AND NOT (w[x] = 'peut' AND coalesce(w[x + 1], '') IN ('être', 'etre'))" if k == "possibility" else f"x IN {_IN(ws)}") + f")))::BIGINT AS {k}" for k, ws in _WORDING.items()
) + f", sum(len({_PAIRS}) + len({_ALONE}))::BIGINT AS negation FROM o GROUP BY party) "
WORDING_SQL = _STYLE_SQL + ", l AS (" + " UNION ALL ".join(f"SELECT party, words, '{k}' AS key, {k} AS n FROM w" for k in _MEASURES) + """),
        r AS (SELECT *, n * 1000.0 / words AS rate, sum(n) OVER (PARTITION BY key) * 1000.0 / sum(words) OVER (PARTITION BY key) AS chamber FROM l), s AS (SELECT party, key, round(rate, 9) AS rate, round(chamber, 9) AS chamber, round(rate / chamber, 9) AS ratio FROM r WHERE words >= 500 AND chamber > 0)"""
_MARKERS = f"""WITH {ASIDES}, o AS (SELECT aside_id, string_split({words_sql("coalesce(quote, '')")}, ' ') AS w FROM aside), n AS (SELECT aside_id, w,
        {_PAIRS} AS pairs, {_ALONE} AS alone FROM o)
        SELECT aside_id, (len(pairs) + len(alone))::INTEGER AS negations, len(regexp_extract_all('  ' || array_to_string(w, '  ') || '  ', '{_ADDRESS}'))::INTEGER AS addresses,
        CASE WHEN list_has_any(w, {list(speech.PROCEDURE)}) THEN 'procedure' WHEN list_has_any(w, {list(speech.STANCE)}) THEN 'stance' WHEN list_has_any(w, {list(speech.PRONOUN)}) THEN 'pronoun' END AS kind FROM n"""
_LAB = "lab AS (SELECT DISTINCT sid, domain_id FROM topic_labels WHERE domain_id IS NOT NULL)"
_ALL = {
    "v1_politicians": (v1_politicians, f"""WITH {SAID}, {_LAB}, own AS (SELECT * FROM said WHERE pid IS NOT NULL), t AS (SELECT sum(words) AS whole FROM own),
        a AS (SELECT pid, count(*) AS speeches, coalesce(sum(words), 0)::BIGINT AS words, count(DISTINCT session_uid) AS sittings, min(day)::VARCHAR AS first_day, max(day)::VARCHAR AS last_day, max((day, sid, debate_title)).debate_title AS latest_debate FROM (SELECT * FROM own) GROUP BY pid),
        th AS (SELECT pid, domain_id, count(*) AS n FROM own JOIN lab USING (sid) GROUP BY ALL), f AS (SELECT pid, arg_min(domain_id, (-n, domain_id)) AS subject FROM th GROUP BY pid),
        s AS (SELECT acteur_id, department, row_number() OVER (PARTITION BY acteur_id ORDER BY ({day_sql("end_date")} IS NULL OR {day_sql("end_date")} = DATE '9999-12-31')::INT DESC, {day_sql("start_date")} DESC, department DESC NULLS LAST) AS r FROM seats WHERE {day_sql("start_date")} IS NOT NULL)
        SELECT p.pid, p.id, coalesce(p.party, '') AS party, coalesce(speeches, 0) AS speeches, coalesce(words, 0)::BIGINT AS words, coalesce(sittings, 0) AS sittings, first_day, last_day, latest_debate, subject, department, round(coalesce(words, 0) / whole, 9) AS share
        FROM politicians p LEFT JOIN a ON a.pid = p.pid LEFT JOIN f ON f.pid = p.pid LEFT JOIN s ON s.acteur_id = p.acteur_id AND s.r = 1, t""".replace("max((day, sid, debate_title)).debate_title", "arg_max(coalesce(debate_title, chr(0)), (day, sid))").replace("latest_debate, subject", "nullif(latest_debate, chr(0)) AS latest_debate, subject")),
    "v2_parties": (v2_parties, f"""WITH {SAID}, own AS (SELECT * FROM said WHERE party <> ''), t AS (SELECT sum(words) AS whole FROM own), s AS (SELECT party, count(*) AS speeches, count(DISTINCT pid) AS speakers, sum(words)::BIGINT AS words FROM own GROUP BY party),
        m AS (SELECT party, count(*) AS members FROM politicians WHERE party <> '' GROUP BY 1), n AS (SELECT party, pid, count(*) AS n FROM own WHERE pid IS NOT NULL GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY party ORDER BY n DESC, pid) AS r FROM n),
        b AS (SELECT party, string_agg(pid::VARCHAR, ',' ORDER BY r) AS most_active FROM r WHERE r <= 3 GROUP BY party)
        SELECT s.*, coalesce(members, 0) AS members, most_active, round(words / whole, 9) AS share FROM s LEFT JOIN m ON m.party = s.party LEFT JOIN b ON b.party = s.party, t"""),
    "v3_themes": (v3_themes, f"""WITH {SAID}, {_LAB}, own AS (SELECT said.*, domain_id FROM said JOIN lab USING (sid) WHERE party <> ''), n AS (SELECT domain_id, party, count(*) AS n FROM own GROUP BY ALL), l AS (SELECT domain_id, arg_min(party, (-n, party)) AS leader, max(n) AS n FROM n GROUP BY 1)
        SELECT own.domain_id, count(*) AS speeches, count(DISTINCT pid) AS people, min(day)::VARCHAR AS first_day, max(day)::VARCHAR AS last_day, count(DISTINCT strftime(day, '%G-W%V')) AS weeks, arg_min(party, (day, sid)) AS opener, any_value(leader) AS leader, round(any_value(n) / count(*), 9) AS leader_share
        FROM own JOIN l ON l.domain_id = own.domain_id GROUP BY own.domain_id"""),
    "v4_assembly": (v4_assembly, f"WITH {SAID} SELECT count(*) AS speeches, count(DISTINCT pid) AS people, count(DISTINCT session_uid) AS sittings, sum(words)::BIGINT AS words, count(DISTINCT party) AS groups, min(month) AS first_month, max(month) AS last_month FROM said"),
    "v5_rankings": (v5_rankings, f"""WITH {ASIDES}, own AS (SELECT pid, kind, (coalesce(every_bench, 0) = 1 OR coalesce(unnamed_benches, 0) = 1 OR len(list_filter(coalesce(group_codes, []), lambda g: g <> coalesce(p.party, ''))) > 0)::INT AS wide FROM aside JOIN politicians p USING (acteur_id) WHERE record_type = 'reaction' AND acteur_id <> ''),
        c AS (SELECT pid, sum(CASE WHEN kind = 'applaudissement' THEN wide ELSE 0 END)::BIGINT AS a, sum((kind = 'protestation')::INT)::BIGINT AS b FROM own GROUP BY pid)
        (SELECT 'applauded' AS list, pid, a AS count FROM c WHERE a > 0 ORDER BY a DESC, pid LIMIT 10) UNION ALL (SELECT 'protested', pid, b FROM c WHERE b > 0 ORDER BY b DESC, pid LIMIT 10)"""),
    "v7_digest": (v7_digest, f"WITH {SAID}, l AS (SELECT max(day) AS d FROM said) SELECT pid, count(*) AS speeches, sum(words)::BIGINT AS words, max(day)::VARCHAR AS latest FROM said, l WHERE day > d - 90 AND pid IS NOT NULL GROUP BY pid"),
    "q11_style": (q11_style, _STYLE_SQL + "SELECT * FROM w"),
    "v10_wording": (v10_wording, WORDING_SQL + f""", p AS (SELECT *, row_number() OVER (PARTITION BY party ORDER BY abs(ln(greatest(ratio, 1e-6))) DESC, key)::INTEGER AS rank_no FROM s WHERE ratio >= {STANDS_OUT} OR ratio <= 1 / {STANDS_OUT}) SELECT * FROM p WHERE rank_no <= 3"""),
    "v17_people": (v17_people, f"""WITH {SAID}, a AS (SELECT pid, count(*) AS speeches FROM said WHERE pid IS NOT NULL GROUP BY pid), o AS (SELECT p.party, p.pid, regexp_extract(full_name, '(\\S+)$', 1) AS surname, coalesce(speeches, 0) AS speeches FROM politicians p LEFT JOIN a ON a.pid = p.pid WHERE party <> '')
        SELECT party, count(*) AS people, string_agg(surname || ':' || pid || ':' || speeches, ';' ORDER BY surname, pid) AS listed FROM o GROUP BY party"""),
    "v18_places": (v18_places, """WITH o AS (SELECT * FROM seats WHERE department <> ''), n AS (SELECT department_name, list(DISTINCT constituency_no) FILTER (constituency_no IS NOT NULL) AS l FROM o WHERE department_name <> '' GROUP BY 1),
        c AS (SELECT department, list(DISTINCT constituency_no) FILTER (constituency_no IS NOT NULL) AS m, max(department_name) AS department_name FROM o GROUP BY 1)
        SELECT department, c.department_name, coalesce(len(m), 0)::INTEGER AS own, len(list_distinct(list_concat(coalesce(m, []), coalesce(l, []))))::INTEGER AS inherited FROM c LEFT JOIN n ON n.department_name = c.department_name"""),
    "q12_markers": (q12_markers, _MARKERS),
    "q16_mentions": (q16_mentions, None),
    "q20_text_themes": (q20_text_themes, None),
    "t16_best_paragraph": (t16_best_paragraph, f"""WITH p AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda p: trim(regexp_replace(p, '\\s+', ' ', 'g'))), lambda p: p <> '') AS l FROM documents WHERE text IS NOT NULL),
        e AS (SELECT doc_id, unnest(range(len(l))) AS pos, unnest(l) AS p FROM p), h AS (SELECT doc_id, pos, len(list_filter(string_split({fold_sql("p")}, ' '), lambda w: w IN ('loi', 'article', 'groupe'))) AS hits, least(length(p), 600) AS n FROM e),
        r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY hits DESC, n DESC, pos) AS r FROM h) SELECT doc_id, hits::INTEGER AS hits, pos::INTEGER AS pos FROM r WHERE r = 1"""),
    "x5_tfidf_rows": (x5_tfidf_rows, f"""WITH {SPOKEN}, o AS (SELECT sid, tokens FROM spoken WHERE len(tokens) > 0), n AS (SELECT count(*) AS n FROM o), tf AS (SELECT sid, term, count(*) AS tf FROM (SELECT sid, unnest(tokens) AS term FROM o) GROUP BY ALL),
        d AS (SELECT term, count(*) AS df FROM tf GROUP BY 1), w AS (SELECT sid, term, (1 + ln(tf)) * (ln((1 + n) / (1 + df)) + 1) AS w FROM tf JOIN d USING (term), n WHERE df >= 3 AND df <= 0.5 * n), l AS (SELECT sid, sqrt(sum(w * w)) AS l FROM w GROUP BY 1)
        SELECT term, count(*) AS documents, round(sum(w / l), 6) AS weight FROM w JOIN l USING (sid) GROUP BY term"""),
    "x8_topics": (x8_topics, None),
    "r14_groups_in_order": (r14_groups_in_order, f"""WITH {SAID}, w AS (SELECT party, sum(words)::BIGINT AS words FROM said WHERE party <> '' GROUP BY 1), m AS (SELECT party, count(*) AS members FROM politicians WHERE party <> '' GROUP BY 1)
        SELECT w.party, words, coalesce(members, 0) AS members, row_number() OVER (ORDER BY words DESC, w.party)::INTEGER AS place FROM w LEFT JOIN m ON m.party = w.party"""),
    "w5_deciles": (w5_deciles, CHAMBER_SQL["v6_chamber"].rsplit("SELECT * FROM chamber", 1)[0] + """, o AS (SELECT pid, coalesce(p.party, '') AS party, round(interruptions / sittings, 9) AS rate FROM chamber JOIN politicians p USING (pid)),
        e AS (SELECT party, list_sort(list(rate)) AS v, count(*) AS pool FROM o GROUP BY 1) SELECT pid, o.party, rate, pool FROM o JOIN e ON e.party = o.party WHERE pool >= 5 AND rate >= v[floor(0.9 * (pool - 1) + 0.5)::INT + 1]"""),
    "r21_statuses": (r21_statuses, "SELECT coalesce(o_orderstatus, 'none') AS status, count(*) AS n, count(DISTINCT c_custkey) AS customers FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1"),
    "a17_censure": (a17_censure, """WITH c AS (SELECT l_suppkey, count(DISTINCT l_orderkey) AS members, count(DISTINCT CASE WHEN l_returnflag = 'R' THEN l_orderkey END) AS signed FROM lineitem GROUP BY 1) SELECT *, CASE WHEN signed * 2 > members THEN 'pour' ELSE 'contre' END AS position FROM c"""),
    "a14_weekly_shares": (a14_weekly_shares, f"""WITH {SAID}, {_LAB}, c AS (SELECT domain_id, strftime(day, '%G-W%V') AS week, party, count(*) AS n FROM said JOIN lab USING (sid) WHERE party <> '' AND day IS NOT NULL GROUP BY ALL) SELECT *, round(n / sum(n) OVER (PARTITION BY domain_id, week), 9) AS share FROM c"""),
}
QUERIES = {name: run for name, (run, _) in _ALL.items()}
SQL = {name: sql for name, (_, sql) in _ALL.items() if sql}
