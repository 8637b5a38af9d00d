"""Records of the archive put together: identities, dossiers, catalogues, dates, agreement."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from plenaria.functions import room, speech, stances
from plenaria.functions.periods import Period, presets
from plenaria.functions.text import ACCENTED, BARE, CRAWLERS, campaign, constituency, digit_runs, fold, fold_aligned, is_crawler, paris_day, slug
from plenaria.operators import lexical, lookups
from plenaria.operators.attribution import attributed
from plenaria.operators.ranks import peer_ranks
from plenaria.operators.scan import numbered
from plenaria.operators.topk import top_k
from plenaria.plans.base import ASIDES, POSITIONS, SAID, asides, fold_sql, people, positions, said
from plenaria.plans.chamber import j7_next_aside_all, v6_chamber
from plenaria.plans.chamber import SQL as CHAMBER_SQL
from plenaria.plans.history import SQL as HISTORY_SQL
from plenaria.plans.history import day_sql, p5_group_then
from plenaria.plans.phrases import SQL as PHRASES_SQL
from plenaria.plans.phrases import party_phrases
from plenaria.plans.views import WORDING_SQL, wording_rates
from plenaria.sources.tables import day, end_day, table


def _labels(spark, sf_dir):
    return table(spark, sf_dir, "topic_labels").where("sid is not null and domain_id is not null").distinct()


def _rules(spark, sf_dir):
    words = table(spark, sf_dir, "domains").select("domain_id", F.explode("keywords").alias("k")).select("domain_id", fold("k").alias("k")).where("k <> ''").orderBy("domain_id", "k").collect()  # a fixed list
    return [speech.Rule(r["domain_id"], r["k"]) for r in words]


# --- filters and periods -----------------------------------------------------------


def f2_periods(spark, sf_dir):
    """The archive's presets, and a period asked for that is cut to the archive."""
    edge = said(spark, sf_dir).agg(F.min("month").alias("a"), F.max("month").alias("b")).first()
    rows = []
    if edge["a"] is not None:
        archive = Period(edge["a"], edge["b"])
        rows = [(name, p.first, p.last) for name, p in presets(archive).items()]
        if (cut := Period("2022-05", "2099-12").within(archive)) is not None:
            rows.append(("asked", cut.first, cut.last))
    return spark.createDataFrame(rows, "name string, first string, last string")


def f9_theme_or_domain(spark, sf_dir):
    """Speeches of each group that a label or a title gives one of two subjects."""
    own = said(spark, sf_dir, "debate_title")
    marked = own.join(_labels(spark, sf_dir).where(F.col("domain_id").isin("sante", "justice")).select("sid", F.lit(1).alias("labelled")).distinct(), "sid", "left")
    chosen = marked.where(F.col("labelled").isNotNull() | fold(F.coalesce("debate_title", F.lit(""))).contains("budget"))
    return chosen.groupBy("party").agg(F.count(F.lit(1)).alias("speeches"), F.count("labelled").alias("labelled"))


def f13_probes(spark, sf_dir):
    """Which record types the asides hold, by a probe for one row each."""
    own = table(spark, sf_dir, "asides", "record_type")
    return spark.createDataFrame([(t, not own.where(F.col("record_type") == t).limit(1).isEmpty()) for t in ("interruption", "reaction", "vote")], "record_type string, held boolean")


def f14_people(spark, sf_dir):
    """People of listed groups whose folded name or department holds ``an``, with a visible seat."""
    seats = table(spark, sf_dir, "seats").where("department_name <> ''").groupBy("acteur_id").agg(F.min("department_name").alias("department"))
    own = people(spark, sf_dir).where(F.col("party").isin("ALV", "SOL", "FDM")).join(seats, "acteur_id")
    return own.where(fold("full_name").contains("an") | fold("department").contains("an")).select("pid", "full_name", "department")


def r19_search(spark, sf_dir):
    """The ten people with most words whose folded name holds ``el``."""
    words = said(spark, sf_dir, "words").where("pid is not null").groupBy("pid").agg(F.sum("words").alias("words"))
    own = people(spark, sf_dir).where(fold("full_name").contains("el")).join(words, "pid", "left").withColumn("words", F.coalesce("words", F.lit(0)))
    return own.orderBy(F.desc("words"), "pid").limit(10).select("pid", "full_name", "words")


# --- dossiers and titles -------------------------------------------------------------


def j8_any_title(spark, sf_dir):
    """Any title of a person's dossiers: the first in order."""
    return said(spark, sf_dir, "dossier_title").where("pid is not null and dossier_title <> ''").groupBy("pid").agg(F.min("dossier_title").alias("title"))


def j11_group_or_latest(spark, sf_dir):
    """Each speaker's group as known on the day, else the one of the latest membership."""
    rows = table(spark, sf_dir, "memberships").select("acteur_id", F.coalesce("party", F.lit("")).alias("party"), day("start_date").alias("s"), day("known_on").alias("k")).where("s is not null and k is not null")
    last = lookups.latest(rows, "acteur_id", ["s", "k"], ["party"])
    return p5_group_then(spark, sf_dir).join(last, "acteur_id", "left").select("sid", F.coalesce(F.when(F.col("party_then") != "", F.col("party_then")), "party", F.lit("")).alias("author_group"))


def j15_dossiers(spark, sf_dir):
    """The bill of each speech: its own number, else that of the dossier of equal title; by how it was found."""
    own = said(spark, sf_dir, "bill_number", "dossier_title")
    titled = own.where("bill_number <> '' and dossier_title <> ''").groupBy("dossier_title").agg(F.min("bill_number").alias("titled"))
    found = own.join(titled, "dossier_title", "left").withColumn("bill", F.coalesce(F.when(F.col("bill_number") != "", F.col("bill_number")), "titled"))
    how = F.when(F.col("bill_number") != "", "number").when(F.col("bill").isNotNull(), "title").otherwise("none")
    return found.groupBy(how.alias("how")).agg(F.count(F.lit(1)).alias("speeches"), F.countDistinct("bill").alias("bills"))


def j19_same_title(spark, sf_dir):
    """Asides and speeches of one title, matched across the two tables."""
    a = asides(spark, sf_dir).where("debate_topic <> ''").groupBy(F.col("debate_topic").alias("title")).agg(F.count(F.lit(1)).alias("asides"))
    s = said(spark, sf_dir, "debate_title").where("debate_title <> ''").groupBy(F.col("debate_title").alias("title")).agg(F.count(F.lit(1)).alias("speeches"))
    return a.join(s, "title")


_KEY_PREFIXES = ("proposition de loi", "mission d information", "explications de vote")


def r1_key_debates(spark, sf_dir):
    """Debates of note: motions, or folded titles that begin with one of three phrases."""
    title = fold(F.coalesce("debate_title", F.lit("")))
    own = said(spark, sf_dir, "debate_title", "section_code").withColumn("key", (F.col("section_code").eqNullSafe("MOTION") | title.rlike("^(?:" + "|".join(_KEY_PREFIXES) + ")")).cast("int"))
    return own.groupBy("section_code", "key").agg(F.count(F.lit(1)).alias("speeches"))


def r2_debate_subjects(spark, sf_dir):
    """Subjects of each pair of titles by the subjects' expressions: of the debate, then of the dossier, each once."""
    book = speech.RuleBook(_rules(spark, sf_dir))
    pairs = said(spark, sf_dir, "debate_title", "dossier_title").select(F.coalesce("debate_title", F.lit("")).alias("debate"), F.coalesce("dossier_title", F.lit("")).alias("dossier")).distinct()

    def subjects(titles):
        return titles.map(book.title_themes)

    named = F.pandas_udf(subjects, "array<string>")
    return pairs.select("debate", "dossier", F.array_join(F.array_distinct(F.concat(named(fold("debate")), named(fold("dossier")))), ",").alias("subjects"))


def v14_dossiers(spark, sf_dir):
    """Each bill's first and last day, kind, first speaker, titles and labelled subjects."""
    own = said(spark, sf_dir, "bill_number", "dossier_title").where("bill_number <> ''")
    title = fold(F.coalesce("dossier_title", F.lit("")))
    kind = F.when(title.startswith("projet de loi"), "projet").when(title.startswith("proposition de"), "proposition").otherwise("autre")
    base = own.groupBy("bill_number").agg(
        F.min("day").cast("string").alias("first_day"), F.max("day").cast("string").alias("last_day"), F.min_by("sid", F.struct("day", "sid")).alias("first_sid"), F.countDistinct("dossier_title").alias("titles"), F.min(kind).alias("kind"), F.count(F.lit(1)).alias("speeches"),
    )
    themes = own.join(_labels(spark, sf_dir), "sid").groupBy("bill_number").agg(F.array_join(F.array_sort(F.collect_set("domain_id")), ",").alias("subjects"))
    return base.join(themes, "bill_number", "left").withColumn("subjects", F.coalesce("subjects", F.lit("")))


def v11_agenda(spark, sf_dir):
    """Sittings of the archive's last 31 days, and motions of the first 7 of them."""
    own = said(spark, sf_dir, "section_code", "debate_title")
    today = F.lit(own.agg(F.date_sub(F.max("day"), 30)).first()[0]).cast("date")
    ahead = own.where(F.col("day").between(today, F.date_add(today, 30)))
    sittings = ahead.groupBy("day", "session_uid").agg(F.lit("sitting").alias("kind"), F.count(F.lit(1)).alias("items"))
    motions = ahead.where((F.col("section_code") == "MOTION") & (F.col("day") < F.date_add(today, 7))).groupBy("day", "session_uid").agg(F.lit("motion").alias("kind"), F.count(F.lit(1)).alias("items"))
    return sittings.unionByName(motions).withColumn("day", F.col("day").cast("string"))


# --- identities ------------------------------------------------------------------------


def _spoken_name(c):
    """A folded label without civility."""
    return F.regexp_replace(fold(c), "^(?:monsieur|madame|m|mme|mm) ", "")


def r3_inherited_groups(spark, sf_dir):
    """Groups of speeches: stated, inherited from the same name where it has one group only, or unknown."""
    own = said(spark, sf_dir, "speaker").withColumn("name", _spoken_name(F.coalesce("speaker", F.lit("")))).where("name <> ''")
    single = own.where("party <> ''").groupBy("name").agg(F.countDistinct("party").alias("n"), F.min("party").alias("inherited")).where("n = 1").drop("n")
    joined = own.join(single, "name", "left")
    status = F.when(F.col("party") != "", "stated").when(F.col("inherited").isNotNull(), "inherited").otherwise("unknown")
    return joined.groupBy(status.alias("status"), F.coalesce(F.when(F.col("party") != "", F.col("party")), "inherited", F.lit("")).alias("group")).agg(F.count(F.lit(1)).alias("speeches"))


def r4_identities(spark, sf_dir):
    """Who speaks: the person's number, else a slug of the name; collective speakers are left out, ministers are the government."""
    own = said(spark, sf_dir, "speaker", "acteur_id", "qualite").where("speaker <> ''")
    named = own.withColumn("name", fold("speaker")).where(~F.col("name").rlike("^(?:des|un|une|plusieurs|les|quelques) "))
    who = F.coalesce(F.when(F.trim("acteur_id") != "", F.trim("acteur_id")), slug(_spoken_name("speaker")))
    side = F.when(fold(F.coalesce("qualite", F.lit(""))).rlike("(?:^| )(?:ministre|secretaire d etat)"), "GOUV").otherwise(F.col("party"))
    return named.groupBy(who.alias("who"), side.alias("side")).agg(F.count(F.lit(1)).alias("speeches"))


def r5_first_places(spark, sf_dir):
    """Debate titles numbered by their first day, then by title."""
    titles = said(spark, sf_dir, "debate_title").where("debate_title <> '' and day is not null").groupBy("debate_title").agg(F.min("day").cast("string").alias("first_day"))
    return numbered(titles, ["first_day", "debate_title"], "place")


def w20_places_in_rows(spark, sf_dir):
    """Members of each group by department and name, dealt to ten rows in turn."""
    seats = table(spark, sf_dir, "seats").where("department <> ''").groupBy("acteur_id").agg(F.max("department").alias("department"))
    own = people(spark, sf_dir).where("party <> ''").join(seats, "acteur_id")
    order = F.row_number().over(Window.partitionBy("party").orderBy(F.desc("department"), "full_name", "pid"))
    return own.select("party", "pid", order.alias("place"), ((order - 1) % 10).alias("row"))


def r18_rank_text(spark, sf_dir):
    """How each person's number of speeches stands among the group: as a share of the peers, or as a place among groups of fewer than ten."""
    own = v6_chamber(spark, sf_dir).join(people(spark, sf_dir).where("party <> ''").select("pid", "party"), "pid").select("pid", "party", "speeches")
    ranked = peer_ranks(own, "speeches", ["party"])
    share = F.floor(F.col("lower") * 100 / F.col("pool"))
    text = F.when(F.col("pool") < 10, F.concat((F.col("higher") + 1).cast("string"), F.lit(". of "), F.col("pool").cast("string"))).when(share >= 50, F.concat(F.lit("more than "), share.cast("string"), F.lit(" %"))).otherwise(F.concat(F.lit("less than "), F.floor(F.col("higher") * 100 / F.col("pool")).cast("string"), F.lit(" %")))
    return ranked.select("pid", F.when(F.col("pool").isNotNull(), text).alias("text"))


# --- dates, catalogues -------------------------------------------------------------------


def r6_sessions(spark, sf_dir):
    """Sessions from October to September that cover the archive."""
    edge = said(spark, sf_dir).agg(F.min("day").alias("a"), F.max("day").alias("b"))
    first, last = F.year("a") - (F.month("a") < 10).cast("int"), F.year("b") - (F.month("b") < 10).cast("int")
    years = edge.where("a is not null").select(F.explode(F.sequence(first, last)).alias("y"))
    return years.select(F.concat_ws("-", F.col("y").cast("string"), (F.col("y") + 1).cast("string")).alias("session"), F.make_date("y", F.lit(10), F.lit(1)).cast("string").alias("first"), F.make_date(F.col("y") + 1, F.lit(9), F.lit(30)).cast("string").alias("last"))


def r7_catalogue(spark, sf_dir):
    """Subjects and, under them, their expressions."""
    own = table(spark, sf_dir, "domains")
    top = own.select(F.col("domain_id").alias("id"), "label", F.lit("").alias("parent"))
    return top.unionByName(own.select("domain_id", F.explode("keywords").alias("k")).select(slug("k").alias("id"), F.col("k").alias("label"), F.col("domain_id").alias("parent")))


def r8_subject_lists(spark, sf_dir):
    """Each labelled speech's subjects as one list in order."""
    return _labels(spark, sf_dir).groupBy("sid").agg(F.array_join(F.array_sort(F.collect_list("domain_id")), ",").alias("subjects"))


def r9_first_judgement(spark, sf_dir):
    """Each speech's subject by the first judge that has one: the label, then the title's longest expression."""
    needles = {r.phrase: r.theme for r in _rules(spark, sf_dir)}
    own = said(spark, sf_dir, "debate_title").select("sid", fold(F.coalesce("debate_title", F.lit(""))).alias("t"))
    found = lookups.longest_contained(own.where("t <> ''"), "sid", "t", list(needles), "k")
    theme = F.element_at(F.create_map(*[F.lit(x) for pair in needles.items() for x in pair]), F.col("k"))
    labels = _labels(spark, sf_dir).groupBy("sid").agg(F.min("domain_id").alias("label"))
    joined = own.join(labels, "sid", "left").join(found.select("sid", theme.alias("title")), "sid", "left")
    judge = F.when(F.col("label").isNotNull(), "label").when(F.col("title").isNotNull(), "title")
    return joined.where("label is not null or title is not null").groupBy(judge.alias("judge"), F.coalesce("label", "title").alias("subject")).agg(F.count(F.lit(1)).alias("speeches"))


def r22_gaps(spark, sf_dir):
    """Days from a speech to the speaker's next reaction: none, up to thirty, more."""
    gap = F.when(F.col("gap_days") == 0, "same day").when(F.col("gap_days") <= 30, "within 30 days").otherwise("later")
    return j7_next_aside_all(spark, sf_dir).groupBy(gap.alias("gap")).agg(F.count(F.lit(1)).alias("speeches"), F.max("gap_days").alias("longest"))


# --- agreement, evaluation --------------------------------------------------------------------


def a21_agreement(spark, sf_dir):
    """How often each group's members take the position that they took on their ballot before."""
    w = Window.partitionBy("person").orderBy("ballot")
    pairs = positions(spark, sf_dir).withColumn("before", F.lag("position").over(w)).where("before is not null")
    return pairs.groupBy("party").agg(F.count(F.lit(1)).alias("compared"), F.sum((F.col("before") == F.col("position")).cast("int")).alias("agreeing"))


def v13_gaps(spark, sf_dir):
    """The latest ballot of each person with another position than on the ballot before."""
    w = Window.partitionBy("person").orderBy("ballot")
    pairs = positions(spark, sf_dir).withColumn("before", F.lag("position").over(w)).withColumn("ballot_before", F.lag("ballot").over(w)).where("before <> position")
    best = pairs.groupBy("person").agg(F.max(F.struct("ballot", "ballot_before", "before", "position")).alias("_b"))
    return best.select("person", "_b.*")


def a29_judged(spark, sf_dir):
    """How often the title's longest expression names a labelled subject, by half of the sample and in all; the first judgement of each speech counts."""
    needles = {r.phrase: r.theme for r in _rules(spark, sf_dir)}
    own = said(spark, sf_dir, "debate_title").select("sid", fold(F.coalesce("debate_title", F.lit(""))).alias("t")).where("t <> ''")
    found = lookups.longest_contained(own, "sid", "t", list(needles), "k")
    theme = F.element_at(F.create_map(*[F.lit(x) for pair in needles.items() for x in pair]), F.col("k"))
    labels = _labels(spark, sf_dir).groupBy("sid").agg(F.collect_set("domain_id").alias("l"))
    judged = found.select("sid", theme.alias("theme")).join(labels, "sid").withColumn("sample", F.when(F.col("sid") % 2 == 0, "dev").otherwise("holdout")).withColumn("right", F.array_contains("l", F.col("theme")).cast("int"))
    return judged.rollup("sample").agg(F.count(F.lit(1)).alias("judged"), F.sum("right").alias("right")).withColumn("sample", F.coalesce("sample", F.lit("all")))


def x10_headlines(spark, sf_dir):
    """Each group's bigrams of note: shown as counts where the others use them five times as often at most or the ratio passes 100, else as a ratio; exclusive where nobody else does."""
    counts, totals, corpus = party_phrases(spark, sf_dir)
    scored = lexical.distinctive(counts, totals, corpus, "party", least_sittings=3)
    best = top_k(scored, ["party"], [F.desc(F.round("z", 9)), F.asc("ngram")], 5)
    form = F.when((F.col("rest") <= 5 * F.col("count")) | (F.col("ratio") > 100), "counts").otherwise("ratio")
    return best.select("party", "rank_no", "ngram", form.alias("form"), (F.col("rest") == 0).alias("exclusive"))


def w16_sentences(spark, sf_dir):
    """What is said of each kind of a group's wording against the chamber's: more or less from half again on."""
    ratio = F.col("ratio")
    text = F.when(ratio >= 1.5, F.concat_ws(" ", F.lit("more"), "key")).when(ratio <= 1 / 1.5, F.concat_ws(" ", F.lit("less"), "key")).otherwise(F.concat_ws(" ", F.lit("about as much"), "key"))
    return wording_rates(spark, sf_dir).select("party", "key", text.alias("text"))


# --- readings -------------------------------------------------------------------------------------


def q9_reactions(spark, sf_dir):
    """Applause and protest that each stage direction tells of, with the groups that it names."""
    parties = sorted(r[0] for r in people(spark, sf_dir).select("party").where("party <> ''").distinct().limit(1000).collect())  # the chamber's groups
    own = asides(spark, sf_dir).where("detail is not null")
    return room.with_reactions(own, "aside_id", "detail", {p: p for p in parties}).select("aside_id", "kind", F.concat_ws(",", "groups").alias("groups"), "every_bench", "unnamed_benches")


_CAMPS = {"ALV": "a", "SOL": "a", "FDM": "b", "RPC": "c", "UCR": "c", "LTR": "d", "ECT": "e"}


def q10_other_camps(spark, sf_dir):
    """How many other camps than the speaker's react."""
    own = asides(spark, sf_dir).where("record_type = 'reaction' and acteur_id <> ''").join(people(spark, sf_dir).select("acteur_id", "party"), "acteur_id")
    found = speech.other_camps(F.coalesce("group_codes", F.array().cast("array<string>")), F.coalesce("every_bench", F.lit(0)), F.coalesce("unnamed_benches", F.lit(0)), F.col("party"), _CAMPS)
    return own.select("aside_id", found.cast("int").alias("camps"))


def q21_stances(spark, sf_dir):
    """Votes announced in speeches and asides, with the sentence that announces them."""
    own = said(spark, sf_dir, "content", "section_code", "debate_title").select(F.concat(F.lit("s"), F.col("sid").cast("string")).alias("id"), F.array_join(F.coalesce("content", F.array().cast("array<string>")), "\n").alias("t"), "section_code", "debate_title")
    more = asides(spark, sf_dir).select(F.concat(F.lit("a"), F.col("aside_id").cast("string")).alias("id"), F.col("quote").alias("t"), F.lit("").alias("section_code"), F.col("debate_topic").alias("debate_title"))
    return stances.with_stances(own.unionByName(more), "id", "t", "section_code", "debate_title")


def x7_attributions(spark, sf_dir):
    """Subjects of speeches: by the debate's titles, else by the text; with the groups of subjects above them."""
    own = said(spark, sf_dir, "content", "debate_title", "dossier_title").select(
        "sid", fold(F.concat_ws(" ", "debate_title", "dossier_title")).alias("titles"), fold(F.array_join(F.coalesce("content", F.array().cast("array<string>")), " ")).alias("text"),
    )
    parents = {d: ("social" if d in ("sante", "ecole", "sport") else "other") for d in {r.theme for r in _rules(spark, sf_dir)}}
    return attributed(own, "sid", "titles", "text", _rules(spark, sf_dir), parents)


def t25_days(spark, sf_dir):
    """Documents by the day of publication in Paris and whether that is the day in UTC."""
    own = table(spark, sf_dir, "documents", "doc_id", "published_at").where("published_at is not null")
    return own.groupBy(paris_day("published_at").cast("string").alias("day")).agg(F.count(F.lit(1)).alias("documents"))


def r10_first_deposits(spark, sf_dir):
    """Where each bill first stands: day, group and section of the first speech on it."""
    own = said(spark, sf_dir, "bill_number", "section_code").where("bill_number <> ''")
    first = own.groupBy("bill_number").agg(F.min(F.struct("day", "sid", "party", F.coalesce("section_code", F.lit("")).alias("section"))).alias("_f"))
    return first.select("bill_number", F.col("_f.day").cast("string").alias("day"), F.col("_f.party").alias("origin"), F.col("_f.section").alias("section"))


def r11_meetings(spark, sf_dir):
    """Each sitting with its day, number of titles, and the title of its first speech that has one."""
    own = said(spark, sf_dir, "debate_title").where("session_uid is not null")
    first = F.min(F.when(F.col("debate_title") != "", F.struct("sid", "debate_title")))["debate_title"]
    return own.groupBy("session_uid").agg(F.min("day").cast("string").alias("day"), F.countDistinct(F.when(F.col("debate_title") != "", F.col("debate_title"))).alias("items"), first.alias("first_title"))


def r12_main_section(spark, sf_dir):
    """The section in which each bill is most debated."""
    counted = said(spark, sf_dir, "bill_number", "section_code").where("bill_number <> '' and section_code <> ''").groupBy("bill_number", "section_code").agg(F.count(F.lit(1)).alias("n"))
    best = counted.groupBy("bill_number").agg(F.min(F.struct((-F.col("n")).alias("n"), "section_code")).alias("_b"))
    return best.select("bill_number", F.col("_b.section_code").alias("section"), (-F.col("_b.n")).alias("speeches"))


def r24_sitting(spark, sf_dir):
    """Sitting members by department: those with an open seat, and whether all have numbers of their own."""
    open_ = table(spark, sf_dir, "seats").where(F.col("department").isNotNull() & (F.col("department") != "") & end_day("end_date").isNull() & day("start_date").isNotNull())
    counted = open_.groupBy("department").agg(F.countDistinct("acteur_id").alias("members"), F.countDistinct("constituency_no").alias("numbers"))
    return counted.withColumn("segment", F.when(F.col("members") == F.col("numbers"), "whole").when(F.col("members") > F.col("numbers"), "shared").otherwise("sparse"))


def r30_attendance(spark, sf_dir):
    """In each sitting, the persons that the speeches name, those that the raw lines name, and those in both."""
    folk = people(spark, sf_dir).select("pid", "acteur_id")
    spoke = said(spark, sf_dir).where("pid is not null and session_uid is not null").join(folk, "pid").select("session_uid", "acteur_id", F.lit(1).alias("s"), F.lit(0).alias("l"))
    lines = table(spark, sf_dir, "transcript_lines", "session_uid", "acteur_id").where("session_uid is not null and acteur_id <> ''").select("session_uid", "acteur_id", F.lit(0).alias("s"), F.lit(1).alias("l"))
    each = spoke.unionByName(lines).groupBy("session_uid", "acteur_id").agg(F.max("s").alias("s"), F.max("l").alias("l"))
    return each.groupBy("session_uid").agg(F.sum("s").alias("in_speeches"), F.sum("l").alias("in_lines"), F.sum(F.col("s") * F.col("l")).alias("both"))


def t29_sources(spark, sf_dir):
    """Documents by cleaned source, machines apart."""
    own = table(spark, sf_dir, "documents", "source")
    return own.groupBy(campaign("source").alias("campaign"), is_crawler("source").alias("crawler")).agg(F.count(F.lit(1)).alias("documents"))


def t3_aligned(spark, sf_dir):
    """Quotes of asides folded sign by sign."""
    own = table(spark, sf_dir, "asides", "aside_id", "quote").where("quote is not null").dropDuplicates(["aside_id"])
    return own.select("aside_id", fold_aligned("quote").alias("folded"), (F.length(fold_aligned("quote")) == F.length("quote")).alias("aligned"))


def t21_numbers(spark, sf_dir):
    """Numbers in the raw lines, in their order."""
    own = table(spark, sf_dir, "transcript_lines", "session_uid", "line_no", "raw_text").where("session_uid is not null and line_no is not null and raw_text is not null").distinct()
    return own.select("session_uid", "line_no", digit_runs("raw_text").alias("numbers")).where("numbers <> ''").distinct()


def t30_constituencies(spark, sf_dir):
    """Codes of constituencies read back into department and number."""
    own = table(spark, sf_dir, "seats").where("department <> '' and constituency_no is not null").select(F.concat("department", F.lpad(F.col("constituency_no").cast("string"), 3, "0")).alias("code")).distinct()
    read = constituency("code", {"976": "mayotte"})
    return own.select("code", read["department"].alias("department"), read["number"].alias("number"))


_LAB = "lab AS (SELECT DISTINCT sid, domain_id FROM topic_labels WHERE sid IS NOT NULL AND domain_id IS NOT NULL)"
_NAME = lambda c: f"regexp_replace({fold_sql(c)}, '^(monsieur|madame|m|mme|mm) ', '')"
_KEYS = f"""keyed AS (SELECT domain_id, {fold_sql("k")} AS k FROM (SELECT domain_id, unnest(keywords) AS k FROM domains)),
longest AS (SELECT sid, arg_min(domain_id, (-length(k), k)) AS theme FROM (SELECT sid, {fold_sql("debate_title")} AS t FROM said WHERE debate_title <> ''), keyed WHERE contains(' ' || t || ' ', ' ' || k || ' ') GROUP BY sid)"""
_LAGGED = f"""{POSITIONS}, lagged AS (SELECT *, lag(position) OVER w AS before, lag(ballot) OVER w AS ballot_before FROM positions WINDOW w AS (PARTITION BY person ORDER BY ballot))"""
_CASE = "CASE {} " + " ".join(f"WHEN '{p}' THEN '{c}'" for p, c in _CAMPS.items()) + " END"

_ALL = {
    "f2_periods": (f2_periods, f"""WITH {SAID}, e AS (SELECT min(month) AS a, max(month) AS b FROM said), d AS (SELECT *, (b || '-01')::DATE AS l FROM e WHERE a IS NOT NULL)
        SELECT 'all' AS name, a AS first, b AS last FROM d UNION ALL SELECT 'year', greatest(a, strftime(l - INTERVAL 11 MONTH, '%Y-%m')), b FROM d UNION ALL SELECT 'quarter', greatest(a, strftime(l - INTERVAL 2 MONTH, '%Y-%m')), b FROM d
        UNION ALL SELECT 'session', greatest(a, (year(l) - (month(l) < 10)::INT)::VARCHAR || '-10'), b FROM d UNION ALL SELECT 'asked', greatest(a, '2022-05'), least(b, '2099-12') FROM d WHERE b >= '2022-05'"""),
    "f9_theme_or_domain": (f9_theme_or_domain, f"""WITH {SAID}, {_LAB}, m AS (SELECT party, sid IN (SELECT sid FROM lab WHERE domain_id IN ('sante', 'justice')) AS labelled, contains({fold_sql("coalesce(debate_title, '')")}, 'budget') AS titled FROM said)
        SELECT party, count(*) AS speeches, count(*) FILTER (labelled) AS labelled FROM m WHERE labelled OR titled GROUP BY party"""),
    "f13_probes": (f13_probes, "SELECT t AS record_type, EXISTS (SELECT 1 FROM asides WHERE record_type = t LIMIT 1) AS held FROM (VALUES ('interruption'), ('reaction'), ('vote')) v(t)"),
    "f14_people": (f14_people, f"""WITH s AS (SELECT acteur_id, min(department_name) AS department FROM seats WHERE department_name <> '' GROUP BY 1) SELECT pid, full_name, department FROM politicians JOIN s USING (acteur_id)
        WHERE party IN ('ALV', 'SOL', 'FDM') AND (contains({fold_sql("full_name")}, 'an') OR contains({fold_sql("department")}, 'an'))"""),
    "r19_search": (r19_search, f"""WITH {SAID}, w AS (SELECT pid, sum(words)::BIGINT AS words FROM said GROUP BY pid) SELECT p.pid, full_name, coalesce(words, 0)::BIGINT AS words FROM politicians p LEFT JOIN w ON w.pid = p.pid WHERE contains({fold_sql("full_name")}, 'el') ORDER BY 3 DESC, 1 LIMIT 10"""),
    "j8_any_title": (j8_any_title, f"WITH {SAID} SELECT pid, min(dossier_title) AS title FROM said WHERE pid IS NOT NULL AND dossier_title <> '' GROUP BY pid"),
    "j11_group_or_latest": (j11_group_or_latest, f"""WITH t AS ({HISTORY_SQL["p5_group_then"]}), m AS (SELECT acteur_id, arg_max(coalesce(party, ''), ({day_sql("start_date")}, {day_sql("known_on")}, coalesce(party, ''))) AS party FROM memberships WHERE {day_sql("start_date")} IS NOT NULL AND {day_sql("known_on")} IS NOT NULL GROUP BY 1)
        SELECT sid, coalesce(nullif(party_then, ''), party, '') AS author_group FROM t LEFT JOIN m ON m.acteur_id = t.acteur_id"""),
    "j15_dossiers": (j15_dossiers, f"""WITH {SAID}, t AS (SELECT dossier_title, min(bill_number) AS titled FROM said WHERE bill_number <> '' AND dossier_title <> '' GROUP BY 1), f AS (SELECT bill_number, coalesce(nullif(bill_number, ''), titled) AS bill FROM said LEFT JOIN t ON t.dossier_title = said.dossier_title)
        SELECT CASE WHEN bill_number <> '' THEN 'number' WHEN bill IS NOT NULL THEN 'title' ELSE 'none' END AS how, count(*) AS speeches, count(DISTINCT bill) AS bills FROM f GROUP BY 1"""),
    "j19_same_title": (j19_same_title, f"""WITH {SAID}, {ASIDES}, a AS (SELECT debate_topic AS title, count(*) AS asides FROM aside WHERE debate_topic <> '' GROUP BY 1), s AS (SELECT debate_title AS title, count(*) AS speeches FROM said WHERE debate_title <> '' GROUP BY 1) SELECT * FROM a JOIN s USING (title)"""),
    "r1_key_debates": (r1_key_debates, f"""WITH {SAID} SELECT section_code, (coalesce(section_code = 'MOTION', false) OR regexp_matches({fold_sql("coalesce(debate_title, '')")}, '^({"|".join(_KEY_PREFIXES)})'))::INTEGER AS key, count(*) AS speeches FROM said GROUP BY ALL"""),
    "r2_debate_subjects": (r2_debate_subjects, None),
    "v14_dossiers": (v14_dossiers, f"""WITH {SAID}, {_LAB}, o AS (SELECT *, {fold_sql("coalesce(dossier_title, '')")} AS t FROM said WHERE bill_number <> ''), b AS (SELECT bill_number, min(day)::VARCHAR AS first_day, max(day)::VARCHAR AS last_day, arg_min(sid, (day, sid)) AS first_sid, count(DISTINCT dossier_title) AS titles,
        min(CASE WHEN starts_with(t, 'projet de loi') THEN 'projet' WHEN starts_with(t, 'proposition de') THEN 'proposition' ELSE 'autre' END) AS kind, count(*) AS speeches FROM o GROUP BY 1), s AS (SELECT bill_number, string_agg(DISTINCT domain_id, ',' ORDER BY domain_id) AS subjects FROM o JOIN lab USING (sid) GROUP BY 1)
        SELECT b.*, coalesce(subjects, '') AS subjects FROM b LEFT JOIN s ON s.bill_number = b.bill_number"""),
    "v11_agenda": (v11_agenda, f"""WITH {SAID}, t AS (SELECT max(day) - 30 AS today FROM said), a AS (SELECT said.*, today FROM said, t WHERE day BETWEEN today AND today + 30)
        SELECT day::VARCHAR AS day, session_uid, 'sitting' AS kind, count(*) AS items FROM a GROUP BY ALL UNION ALL SELECT day::VARCHAR, session_uid, 'motion', count(*) FROM a WHERE section_code = 'MOTION' AND day < today + 7 GROUP BY ALL"""),
    "r3_inherited_groups": (r3_inherited_groups, f"""WITH {SAID}, o AS (SELECT sid, party, {_NAME("coalesce(s.speaker, '')")} AS name FROM said JOIN (SELECT sid, any_value(speaker) AS speaker FROM speeches GROUP BY sid) s USING (sid)), n AS (SELECT * FROM o WHERE name <> ''), u AS (SELECT name, min(party) AS inherited FROM n WHERE party <> '' GROUP BY 1 HAVING count(DISTINCT party) = 1)
        SELECT CASE WHEN party <> '' THEN 'stated' WHEN inherited IS NOT NULL THEN 'inherited' ELSE 'unknown' END AS status, coalesce(nullif(party, ''), inherited, '') AS "group", count(*) AS speeches FROM n LEFT JOIN u USING (name) GROUP BY ALL"""),
    "r4_identities": (r4_identities, f"""WITH {SAID}, o AS (SELECT party, s.*, {fold_sql("s.speaker")} AS name FROM said JOIN (SELECT sid, any_value(speaker) AS speaker, any_value(acteur_id) AS acteur_id, any_value(qualite) AS qualite FROM speeches GROUP BY sid) s USING (sid) WHERE s.speaker <> '')
        SELECT coalesce(nullif(trim(acteur_id), ''), replace({_NAME("speaker")}, ' ', '-')) AS who, CASE WHEN regexp_matches({fold_sql("coalesce(qualite, '')")}, '(^| )(ministre|secretaire d etat)') THEN 'GOUV' ELSE party END AS side, count(*) AS speeches
        FROM o WHERE NOT regexp_matches(name, '^(des|un|une|plusieurs|les|quelques) ') GROUP BY ALL"""),
    "r5_first_places": (r5_first_places, f"""WITH {SAID}, t AS (SELECT debate_title, min(day)::VARCHAR AS first_day FROM said WHERE debate_title <> '' AND day IS NOT NULL GROUP BY 1) SELECT *, row_number() OVER (ORDER BY first_day, debate_title) AS place FROM t"""),
    "w20_places_in_rows": (w20_places_in_rows, """WITH s AS (SELECT acteur_id, max(department) AS department FROM seats WHERE department <> '' GROUP BY 1), r AS (SELECT party, pid, row_number() OVER (PARTITION BY party ORDER BY department DESC, full_name, pid)::INTEGER AS place FROM politicians JOIN s USING (acteur_id) WHERE party <> '') SELECT *, ((place - 1) % 10)::INTEGER AS "row" FROM r"""),
    "r18_rank_text": (r18_rank_text, CHAMBER_SQL["v6_chamber"].rsplit("SELECT * FROM chamber", 1)[0] + """, o AS (SELECT pid, p.party, speeches FROM chamber JOIN politicians p USING (pid) WHERE p.party <> ''),
        w AS (SELECT *, rank() OVER (PARTITION BY party ORDER BY speeches) - 1 AS lo, rank() OVER (PARTITION BY party ORDER BY speeches DESC) - 1 AS hi, count(*) OVER (PARTITION BY party) AS n FROM o)
        SELECT pid, CASE WHEN n < 2 THEN CASE WHEN n < 10 THEN NULL END WHEN n < 10 THEN (hi + 1)::VARCHAR || '. of ' || n WHEN lo * 100 // n >= 50 THEN 'more than ' || (lo * 100 // n) || ' %' ELSE 'less than ' || (hi * 100 // n) || ' %' END AS text FROM w"""),
    "r6_sessions": (r6_sessions, f"""WITH {SAID}, e AS (SELECT min(day) AS a, max(day) AS b FROM said), y AS (SELECT unnest(range(year(a) - (month(a) < 10)::INT, year(b) - (month(b) < 10)::INT + 1)) AS y FROM e WHERE a IS NOT NULL) SELECT y || '-' || (y + 1) AS session, y || '-10-01' AS first, (y + 1) || '-09-30' AS last FROM y"""),
    "r7_catalogue": (r7_catalogue, f"""SELECT domain_id AS id, label, '' AS parent FROM domains UNION ALL SELECT replace({fold_sql("k")}, ' ', '-'), k, domain_id FROM (SELECT domain_id, unnest(keywords) AS k FROM domains)"""),
    "r8_subject_lists": (r8_subject_lists, f"WITH {_LAB} SELECT sid, string_agg(domain_id, ',' ORDER BY domain_id) AS subjects FROM lab GROUP BY sid"),
    "r9_first_judgement": (r9_first_judgement, f"""WITH {SAID}, {_LAB}, {_KEYS}, l AS (SELECT sid, min(domain_id) AS label FROM lab GROUP BY 1), j AS (SELECT label, theme FROM said LEFT JOIN l ON l.sid = said.sid LEFT JOIN longest ON longest.sid = said.sid)
        SELECT CASE WHEN label IS NOT NULL THEN 'label' ELSE 'title' END AS judge, coalesce(label, theme) AS subject, count(*) AS speeches FROM j WHERE label IS NOT NULL OR theme IS NOT NULL GROUP BY ALL"""),
    "r22_gaps": (r22_gaps, f"""WITH j AS ({CHAMBER_SQL["j7_next_aside_all"]}) SELECT CASE WHEN gap_days = 0 THEN 'same day' WHEN gap_days <= 30 THEN 'within 30 days' ELSE 'later' END AS gap, count(*) AS speeches, max(gap_days) AS longest FROM j GROUP BY 1"""),
    "a21_agreement": (a21_agreement, f"WITH {_LAGGED} SELECT party, count(*) AS compared, sum((before = position)::INT)::BIGINT AS agreeing FROM lagged WHERE before IS NOT NULL GROUP BY party"),
    "v13_gaps": (v13_gaps, f"WITH {_LAGGED}, r AS (SELECT *, row_number() OVER (PARTITION BY person ORDER BY ballot DESC) AS r FROM lagged WHERE before <> position) SELECT person, ballot, ballot_before, before, position FROM r WHERE r = 1"),
    "a29_judged": (a29_judged, f"""WITH {SAID}, {_LAB}, {_KEYS}, l AS (SELECT sid, list(domain_id) AS l FROM lab GROUP BY 1), j AS (SELECT CASE WHEN sid % 2 = 0 THEN 'dev' ELSE 'holdout' END AS sample, list_contains(l, theme)::INT AS ok FROM longest JOIN l USING (sid))
        SELECT coalesce(sample, 'all') AS sample, count(*) AS judged, sum(ok)::BIGINT AS "right" FROM j GROUP BY ROLLUP (sample)"""),
    "x10_headlines": (x10_headlines, PHRASES_SQL["x2_distinctive_phrases"].rsplit("SELECT party, rank_no", 1)[0] + "SELECT party, rank_no, ngram, CASE WHEN rest <= 5 * count OR ratio > 100 THEN 'counts' ELSE 'ratio' END AS form, rest = 0 AS exclusive FROM r WHERE rank_no <= 5"),
    "w16_sentences": (w16_sentences, WORDING_SQL + " SELECT party, key, CASE WHEN ratio >= 1.5 THEN 'more ' WHEN ratio <= 1 / 1.5 THEN 'less ' ELSE 'about as much ' END || key AS text FROM s"),
    "q9_reactions": (q9_reactions, None),
    "q10_other_camps": (q10_other_camps, f"""WITH {ASIDES}, o AS (SELECT aside_id, coalesce(every_bench, 0) AS e, coalesce(unnamed_benches, 0) AS u, {_CASE.format("p.party")} AS own, list_distinct(list_filter(list_transform(coalesce(group_codes, []), lambda g: {_CASE.format("g")}), lambda c: c IS NOT NULL)) AS c FROM aside JOIN politicians p USING (acteur_id) WHERE record_type = 'reaction' AND acteur_id <> '')
        SELECT aside_id, (CASE WHEN own IS NULL THEN 0 WHEN e = 1 THEN {len(set(_CAMPS.values())) - 1} WHEN u = 1 THEN greatest(len(list_filter(c, lambda x: x <> own)), 1) ELSE len(list_filter(c, lambda x: x <> own)) END)::INTEGER AS camps FROM o"""),
    "q21_stances": (q21_stances, None),
    "x7_attributions": (x7_attributions, None),
    "r10_first_deposits": (r10_first_deposits, f"""WITH {SAID}, r AS (SELECT bill_number, day::VARCHAR AS day, party AS origin, coalesce(section_code, '') AS section, row_number() OVER (PARTITION BY bill_number ORDER BY day NULLS FIRST, sid) AS r FROM said WHERE bill_number <> '') SELECT * EXCLUDE (r) FROM r WHERE r = 1"""),
    "r11_meetings": (r11_meetings, f"""WITH {SAID} SELECT session_uid, min(day)::VARCHAR AS day, count(DISTINCT nullif(debate_title, '')) AS items, arg_min(debate_title, sid) FILTER (debate_title <> '') AS first_title FROM said WHERE session_uid IS NOT NULL GROUP BY 1"""),
    "r12_main_section": (r12_main_section, f"""WITH {SAID}, c AS (SELECT bill_number, section_code, count(*) AS n FROM said WHERE bill_number <> '' AND section_code <> '' GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY bill_number ORDER BY n DESC, section_code) AS r FROM c) SELECT bill_number, section_code AS section, n AS speeches FROM r WHERE r = 1"""),
    "r24_sitting": (r24_sitting, f"""WITH c AS (SELECT department, count(DISTINCT acteur_id) AS members, count(DISTINCT constituency_no) AS numbers FROM seats WHERE department <> '' AND {day_sql("start_date")} IS NOT NULL AND coalesce({day_sql("end_date")}, DATE '9999-12-31') >= DATE '9999-12-31' GROUP BY 1)
        SELECT *, CASE WHEN members = numbers THEN 'whole' WHEN members > numbers THEN 'shared' ELSE 'sparse' END AS segment FROM c"""),
    "r30_attendance": (r30_attendance, f"""WITH {SAID}, u AS (SELECT session_uid, p.acteur_id, 1 AS s, 0 AS l FROM said JOIN politicians p USING (pid) WHERE session_uid IS NOT NULL UNION ALL SELECT session_uid, acteur_id, 0, 1 FROM transcript_lines WHERE session_uid IS NOT NULL AND acteur_id <> ''), e AS (SELECT session_uid, acteur_id, max(s) AS s, max(l) AS l FROM u GROUP BY ALL)
        SELECT session_uid, sum(s)::BIGINT AS in_speeches, sum(l)::BIGINT AS in_lines, sum(s * l)::BIGINT AS both FROM e GROUP BY 1"""),
    "t29_sources": (t29_sources, f"""SELECT nullif(regexp_replace(substring(regexp_replace(translate(lower(source), '{ACCENTED}', '{BARE}'), '[^a-z0-9_-]+', '-', 'g'), 1, 40), '^-+|-+$', '', 'g'), '') AS campaign, coalesce(source, '') = '' OR regexp_matches(lower(source), '{"|".join(CRAWLERS)}') AS crawler, count(*) AS documents FROM documents GROUP BY ALL"""),
    "t3_aligned": (t3_aligned, f"""SELECT aside_id, regexp_replace(translate(lower(quote), '{ACCENTED}', '{BARE}'), '[^a-z0-9]', ' ', 'g') AS folded, length(lower(quote)) = length(quote) AS aligned FROM (SELECT aside_id, any_value(quote) AS quote FROM asides GROUP BY 1) WHERE quote IS NOT NULL"""),
    "t21_numbers": (t21_numbers, r"SELECT DISTINCT session_uid, line_no, array_to_string(regexp_extract_all(raw_text, '\d+'), ',') AS numbers FROM transcript_lines WHERE session_uid IS NOT NULL AND line_no IS NOT NULL AND len(regexp_extract_all(raw_text, '\d+')) > 0"),
    "t30_constituencies": (t30_constituencies, """WITH c AS (SELECT DISTINCT department || lpad(constituency_no::VARCHAR, 3, '0') AS code FROM seats WHERE department <> '' AND constituency_no IS NOT NULL), w AS (SELECT code, CASE WHEN substr(code, 1, 2) IN ('97', '98') THEN 3 ELSE 2 END AS n FROM c)
        SELECT code, CASE WHEN substr(code, 1, n) = '976' THEN 'mayotte' ELSE substr(code, 1, n) END AS department, try_cast(substr(code, n + 1, 9) AS INTEGER) AS number FROM w"""),
    "t25_days": (t25_days, "SELECT strftime(timezone('Europe/Paris', published_at::TIMESTAMPTZ), '%Y-%m-%d') AS day, count(*) AS documents FROM documents WHERE published_at IS NOT NULL GROUP BY 1"),
}
QUERIES = {name: run for name, (run, _) in _ALL.items()}
SQL = {name: sql for name, (_, sql) in _ALL.items() if sql}
