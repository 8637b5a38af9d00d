"""Phrases: facts, totals, distinctive and rising ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plenaria.functions.text import content_tokens, month_span, shift_month, tokens, words_only
from plenaria.operators import facts, lexical
from plenaria.operators.ranks import merged_phrases
from plenaria.operators.topk import top_k
from plenaria.plans.base import SAID, SPOKEN, grams_sql, said, spoken, words_sql
from plenaria.session import written
from plenaria.sources.tables import table

SIZES = (1, 2, 3)


def _grams(spark: SparkSession, sf_dir: str, sizes: tuple[int, ...] = SIZES) -> DataFrame:
    return facts.exploded_ngrams(spoken(spark, sf_dir), "tokens", sizes, ["sid", "pid", "party", "month", "session_uid"])


def a5_ngram_counts(spark, sf_dir):
    """N-grams used five times or more, with the size of the corpus before pruning."""
    return facts.pruned_counts(_grams(spark, sf_dir), 5)


def a6_person_month(spark, sf_dir):
    """Uses and sittings of each phrase by person and month, from the archive's own counts."""
    uses = table(spark, sf_dir, "speech_ngrams").dropDuplicates(["sid", "gid"])
    months = said(spark, sf_dir).select("sid", "month")
    return uses.where("pid is not null").join(months, "sid").groupBy("pid", "n", "month", "gid").agg(F.sum("uses").alias("count"), F.countDistinct("session_uid").alias("sittings"))


def a7_party_phrases(spark, sf_dir):
    """Bigrams by group with uses and distinct sittings."""
    grams = _grams(spark, sf_dir, (2,)).where("party <> ''")
    return grams.groupBy("party", "ngram").agg(F.count(F.lit(1)).alias("count"), F.countDistinct("session_uid").alias("sittings")).where("count >= 3")


def a8_totals(spark, sf_dir):
    """N-grams of each size by group and month, without exploding them."""
    return facts.ngram_totals(spoken(spark, sf_dir), "tokens", SIZES, ["party", "month"])


_STYLE = {
    "obligation": ("doit", "doivent", "devons", "devez", "faut"),
    "possibility": ("peut", "peux", "peuvent", "pouvons", "pouvez", "pourra", "pourront"),
    "je": ("je", "j"), "nous": ("nous",), "vous": ("vous",),
}


def a9_style(spark, sf_dir):
    """Words of style by person, by group and over all, in one pass."""
    own = spoken(spark, sf_dir)

    def uses(words: tuple[str, ...]):
        return F.size(F.filter("tokens", lambda t: t.isin(list(words))))

    counted = [uses(words).alias(k) for k, words in _STYLE.items()]
    wide = own.select("pid", "party", "month", F.size("tokens").alias("words"), *counted)
    sums = [F.sum(c).alias(c) for c in ("words", *_STYLE)]
    return facts.grouped_at(wide, [["pid", "month"], ["party", "month"], ["month"]], sums).withColumn("grain", F.col("grain").cast("int"))


def a10_distribution(spark, sf_dir):
    """Each person's ten most used bigrams: uses, share, speeches, share of speeches, rank."""
    own = spoken(spark, sf_dir).where("pid is not null")
    grams = facts.exploded_ngrams(own, "tokens", (2,), ["sid", "pid"])
    counted = grams.groupBy("pid", "ngram").agg(F.count(F.lit(1)).alias("count"), F.countDistinct("sid").alias("speeches"))
    totals = own.groupBy("pid").agg(F.sum(F.greatest(F.size("tokens") - 1, F.lit(0))).alias("_n"), F.count(F.lit(1)).alias("_s"))
    joined = counted.where("count >= 2").join(totals, "pid")
    shared = joined.select("pid", "ngram", "count", (F.col("count") / F.col("_n")).alias("share"), "speeches", (F.col("speeches") / F.col("_s")).alias("speech_share"))
    return top_k(shared, ["pid"], [F.desc("count"), F.asc("ngram")], 10)


def a11_party_activity(spark, sf_dir):
    """Speeches, speakers, words and share of each group with 500 words or more."""
    own = spoken(spark, sf_dir).where("party <> ''").groupBy("party").agg(F.count(F.lit(1)).alias("speeches"), F.countDistinct("pid").alias("speakers"), F.sum(F.size("tokens")).alias("words"))
    return own.where("words >= 500")


def party_phrases(spark, sf_dir, n: int = 2):
    """Counts of each group's phrases, its total, and the phrases that the corpus holds five times."""
    own = spoken(spark, sf_dir).where("party <> ''")
    grams = facts.exploded_ngrams(own, "tokens", (n,), ["party", "session_uid"])
    counts = written(grams.groupBy("party", "n", "ngram").agg(F.count(F.lit(1)).alias("count"), F.countDistinct("session_uid").alias("sittings")))  # read three times
    totals = facts.ngram_totals(own, "tokens", (n,), ["party"])
    every = counts.groupBy("n", "ngram").agg(F.sum("count").alias("total"))  # from the counts, not from the text again
    corpus = every.where("total >= 5").join(F.broadcast(every.groupBy("n").agg(F.sum("total").alias("corpus"))), "n")  # one row for each size
    return counts, totals, corpus


def x2_distinctive_phrases(spark, sf_dir):
    """Each group's 25 most distinctive bigrams by log-odds with a Dirichlet prior."""
    scored = lexical.distinctive(*party_phrases(spark, sf_dir), "party", least_sittings=3)
    best = top_k(scored, ["party"], [F.desc(F.round("z", 9)), F.asc("ngram")], 25)
    stable = (F.col("count") >= 10) & (F.col("rest") >= 20)
    return best.select("party", "rank_no", "ngram", "count", "rest", F.round("z", 6).alias("z"), F.when(stable, F.round("ratio", 6)).alias("ratio"))


def x3_smoothed_ratio(spark, sf_dir):
    """Each group's ten bigrams with the highest smoothed log ratio."""
    counts, totals, _ = party_phrases(spark, sf_dir)
    every = counts.groupBy("ngram").agg(F.sum("count").alias("_all"))
    size, whole = every.count(), totals.agg(F.sum("total")).first()[0] or 0
    own = counts.where("count >= 3").join(every, "ngram").join(totals.select("party", "total"), "party")
    score = lexical.smoothed_log_ratio(F.col("count"), F.col("total"), F.col("_all") - F.col("count"), F.lit(whole) - F.col("total"), F.lit(size))
    scored = own.select("party", "ngram", "count", F.round(score, 9).alias("score")).where("score > 0")
    return top_k(scored, ["party"], [F.desc("score"), F.desc("ngram")], 10)


def x4_tfidf(spark, sf_dir):
    """Each person's five phrases with the highest TF-IDF against the others."""
    uses = table(spark, sf_dir, "speech_ngrams").dropDuplicates(["sid", "gid"]).where("pid is not null")
    counts = uses.select("pid", F.col("gid").cast("string").alias("ngram"), F.col("uses").alias("count"))
    scored = lexical.tfidf_vs_rest(counts, "pid", 2).withColumn("tfidf", F.round("tfidf", 9))
    return top_k(scored, ["pid"], [F.desc("tfidf"), F.asc("ngram")], 5)


def w14_rising(spark, sf_dir):
    """Bigrams used more in the last twelve months than in the twelve before."""
    own = spoken(spark, sf_dir)
    last = own.agg(F.max("month").alias("m")).first()["m"]
    if last is None:
        last = "1970-01"
    now_from, before_from, before_to = shift_month(F.lit(last), -11), shift_month(F.lit(last), -23), shift_month(F.lit(last), -12)
    placed = own.withColumn("_now", F.col("month").between(now_from, F.lit(last)).cast("int")).withColumn("_before", F.col("month").between(before_from, before_to).cast("int"))
    placed = placed.where("_now + _before > 0")
    size = F.greatest(F.size("tokens") - 1, F.lit(0))
    totals = placed.agg(F.sum(size * F.col("_now")).alias("a"), F.sum(size * F.col("_before")).alias("b")).first()
    grams = facts.exploded_ngrams(placed, "tokens", (2,), ["_now", "_before"]).groupBy("ngram").agg(F.sum("_now").alias("now"), F.sum("_before").alias("previous"))
    up = lexical.rising(F.col("now"), F.lit(float(totals["a"] or 0)), F.col("previous"), F.lit(float(totals["b"] or 0)))
    scored = grams.where("now >= 15 and now > previous").select("ngram", "now", "previous", F.round(up, 9).alias("lift")).where("lift >= 1.5")
    return scored.orderBy(F.desc("lift"), F.desc("now"), "ngram").limit(25)


def w12_signature(spark, sf_dir):
    """Each group's phrases of two to four words, overlaps merged into the longer one."""
    own = spoken(spark, sf_dir).where("party <> ''")
    counted = facts.exploded_ngrams(own, "tokens", (2, 3, 4), ["party"]).groupBy("party", "n", "ngram").agg(F.count(F.lit(1)).alias("count"))
    best = top_k(counted, ["party", "n"], [F.desc("count"), F.asc("ngram")], 25).drop("rank_no")
    return merged_phrases(best, "party", "ngram", "count", "n", 15)


def t1_words(spark, sf_dir):
    """Asides in plain words, and how many are left without stop words."""
    own = table(spark, sf_dir, "asides", "aside_id", "quote").dropDuplicates(["aside_id"])
    words = tokens(words_only("quote"))
    return own.select("aside_id", words_only("quote").alias("words"), F.size(words).alias("tokens"), F.size(content_tokens(words)).alias("content_tokens"))


def x10_first_months(spark, sf_dir):
    """Months of each group's activity, its span, and the window of equal length before."""
    own = said(spark, sf_dir).where("party <> '' and month is not null").groupBy("party").agg(F.min("month").alias("first"), F.max("month").alias("last"))
    span = month_span("first", "last")
    return own.select("party", "first", "last", span.alias("span"), shift_month("first", -1).alias("before_to"), shift_month("first", -span).alias("before_from"))


def r_month_series(spark, sf_dir):
    """Speeches of each group in every month between its first and last, zeros included."""
    own = said(spark, sf_dir).where("party <> '' and month is not null")
    counted = own.groupBy("party", "month").agg(F.count(F.lit(1)).alias("speeches"))
    bounds = own.groupBy("party").agg(F.min("month").alias("a"), F.max("month").alias("b"))
    first = lambda c: F.to_date(F.concat(F.col(c), F.lit("-01")))
    every = bounds.select("party", F.explode(F.sequence(first("a"), first("b"), F.expr("interval 1 month"))).alias("_m")).select("party", F.date_format("_m", "yyyy-MM").alias("month"))
    return every.join(counted, ["party", "month"], "left").withColumn("speeches", F.coalesce("speeches", F.lit(0)))


_GRAMS = f"WITH {SPOKEN}, {grams_sql(SIZES, 'sid, pid, party, month, session_uid')} "
_TWO = f"WITH {SPOKEN}, {grams_sql((2,), 'sid, pid, party, month, session_uid')} "
_PARTY = (
    _TWO
    + """, counts AS (SELECT party, ngram, count(*) AS count, count(DISTINCT session_uid) AS sittings FROM grams WHERE party <> '' GROUP BY ALL),
totals AS (SELECT party, sum(greatest(len(tokens) - 1, 0)) AS own FROM spoken WHERE party <> '' GROUP BY party),
every AS (SELECT ngram, sum(count) AS everyone FROM counts GROUP BY ngram), corpus AS (SELECT sum(own) AS whole FROM totals) """
)
_STYLE_SQL = ", ".join(f"len(list_filter(tokens, lambda x: x IN ({', '.join(repr(w) for w in ws)}))) AS {k}" for k, ws in _STYLE.items())
_SUMS = ", ".join(f"sum({c})::BIGINT AS {c}" for c in ("words", *_STYLE))
_STOP_SQL = ", ".join(repr(w) for w in __import__("plenaria.functions.text", fromlist=["STOP_WORDS"]).STOP_WORDS)
_ONCE = "once AS (SELECT DISTINCT ON (sid, gid) * FROM speech_ngrams)"

_ALL = {
    "t1_words": (t1_words, f"""WITH own AS (SELECT DISTINCT ON (aside_id) aside_id, quote FROM asides), w AS (SELECT aside_id, {words_sql("quote")} AS words FROM own),
        t AS (SELECT *, list_filter(string_split(words, ' '), lambda x: x <> '') AS toks FROM w)
        SELECT aside_id, words, len(toks)::INTEGER AS tokens, len(list_filter(toks, lambda x: length(x) > 1 AND x NOT IN ({_STOP_SQL})))::INTEGER AS content_tokens FROM t"""),
    "a5_ngram_counts": (a5_ngram_counts, _GRAMS + """, c AS (SELECT n, ngram, count(*) AS total FROM grams GROUP BY ALL), w AS (SELECT n, sum(total)::BIGINT AS corpus FROM c GROUP BY n)
        SELECT n, ngram, total, corpus FROM c JOIN w USING (n) WHERE total >= 5"""),
    "a6_person_month": (a6_person_month, f"WITH {SAID}, {_ONCE} SELECT o.pid, n, month, gid, sum(uses)::BIGINT AS count, count(DISTINCT o.session_uid) AS sittings FROM once o JOIN said USING (sid) WHERE o.pid IS NOT NULL GROUP BY ALL"),
    "a7_party_phrases": (a7_party_phrases, _TWO + "SELECT party, ngram, count(*) AS count, count(DISTINCT session_uid) AS sittings FROM grams WHERE party <> '' GROUP BY ALL HAVING count(*) >= 3"),
    "a8_totals": (a8_totals, f"WITH {SPOKEN} SELECT party, month, n, sum(greatest(len(tokens) - n + 1, 0))::BIGINT AS total FROM spoken, (VALUES (1), (2), (3)) v(n) GROUP BY ALL"),
    "a9_style": (a9_style, f"""WITH {SPOKEN}, wide AS (SELECT pid, party, month, len(tokens) AS words, {_STYLE_SQL} FROM spoken)
        SELECT pid, NULL AS party, month, 1 AS grain, {_SUMS} FROM wide GROUP BY pid, month
        UNION ALL SELECT NULL, party, month, 4, {_SUMS} FROM wide GROUP BY party, month UNION ALL SELECT NULL, NULL, month, 5, {_SUMS} FROM wide GROUP BY month"""),
    "a10_distribution": (a10_distribution, _TWO + """, c AS (SELECT pid, ngram, count(*) AS count, count(DISTINCT sid) AS speeches FROM grams WHERE pid IS NOT NULL GROUP BY ALL),
        t AS (SELECT pid, sum(greatest(len(tokens) - 1, 0)) AS n, count(*) AS s FROM spoken WHERE pid IS NOT NULL GROUP BY pid),
        j AS (SELECT c.pid, ngram, count, count / n AS share, speeches, speeches / s AS speech_share, row_number() OVER (PARTITION BY c.pid ORDER BY count DESC, ngram)::INTEGER AS rank_no FROM c JOIN t ON t.pid = c.pid WHERE count >= 2)
        SELECT * FROM j WHERE rank_no <= 10"""),
    "a11_party_activity": (a11_party_activity, f"WITH {SPOKEN} SELECT party, count(*) AS speeches, count(DISTINCT pid) AS speakers, sum(len(tokens))::BIGINT AS words FROM spoken WHERE party <> '' GROUP BY party HAVING sum(len(tokens)) >= 500"),
    "x2_distinctive_phrases": (x2_distinctive_phrases, _PARTY + """, s AS (SELECT party, ngram, count, own, everyone, whole, 1000.0 * everyone / whole AS a, everyone - count AS rest FROM counts JOIN totals USING (party) JOIN every USING (ngram), corpus
        WHERE count >= 3 AND sittings >= 3 AND everyone >= 5),
        z AS (SELECT *, (ln((count + a) / (own + 1000 - count - a)) - ln((rest + a) / (whole - own + 1000 - rest - a))) / sqrt(1 / (count + a) + 1 / (rest + a)) AS z,
        ((count + 0.5) / (own + 0.5)) / ((rest + 0.5) / (whole - own + 0.5)) AS ratio FROM s),
        r AS (SELECT *, row_number() OVER (PARTITION BY party ORDER BY round(z, 9) DESC, ngram)::INTEGER AS rank_no FROM z WHERE z >= 1.96)
        SELECT party, rank_no, ngram, count, rest::BIGINT AS rest, round(z, 6) AS z, CASE WHEN count >= 10 AND rest >= 20 THEN round(ratio, 6) END AS ratio FROM r WHERE rank_no <= 25"""),
    "x3_smoothed_ratio": (x3_smoothed_ratio, _PARTY + """, v AS (SELECT count(*) AS v FROM every),
        s AS (SELECT party, ngram, count, round(ln((count + 0.5) / (own + 0.5 * v)) - ln((everyone - count + 0.5) / (whole - own + 0.5 * v)), 9) AS score FROM counts JOIN every USING (ngram) JOIN totals USING (party), corpus, v WHERE count >= 3),
        r AS (SELECT *, row_number() OVER (PARTITION BY party ORDER BY score DESC, ngram DESC)::INTEGER AS rank_no FROM s WHERE score > 0) SELECT * FROM r WHERE rank_no <= 10"""),
    "x4_tfidf": (x4_tfidf, f"""WITH {_ONCE}, c AS (SELECT pid, gid::VARCHAR AS ngram, sum(uses)::BIGINT AS count FROM once WHERE pid IS NOT NULL GROUP BY ALL),
        d AS (SELECT ngram, count(*) AS df FROM c GROUP BY ngram), t AS (SELECT pid, sum(count) AS total FROM c GROUP BY pid), o AS (SELECT count(*) AS n FROM t),
        s AS (SELECT c.pid, ngram, count, round(count / total * (ln((1 + n - 1) / (1 + df - 1)) + 1), 9) AS tfidf FROM c JOIN d USING (ngram) JOIN t ON t.pid = c.pid, o WHERE count >= 2),
        r AS (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY tfidf DESC, ngram)::INTEGER AS rank_no FROM s) SELECT * FROM r WHERE rank_no <= 5"""),
    "w12_signature": (w12_signature, f"""WITH {SPOKEN}, {grams_sql((2, 3, 4), "party")}, c AS (SELECT party, n, ngram, count(*) AS count FROM grams WHERE party <> '' GROUP BY ALL), b AS (SELECT *, row_number() OVER (PARTITION BY party, n ORDER BY count DESC, ngram) AS r FROM c), t AS (SELECT party, n, ngram, count FROM b WHERE r <= 25),
        m AS (SELECT s.party, CASE WHEN l.count >= 0.5 * s.count THEN s.ngram ELSE l.ngram END AS ngram FROM t s JOIN t l ON l.party = s.party AND l.n > s.n AND contains(' ' || l.ngram || ' ', ' ' || s.ngram || ' ')),
        f AS (SELECT * FROM t WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.party = t.party AND m.ngram = t.ngram)), k AS (SELECT *, row_number() OVER (PARTITION BY party ORDER BY count DESC, n DESC, ngram)::INTEGER AS pick FROM f) SELECT * FROM k WHERE pick <= 15"""),
    "w14_rising": (w14_rising, _TWO + """, m AS (SELECT max(month) AS m FROM spoken), w AS (SELECT m, strftime((m || '-01')::DATE - INTERVAL 11 MONTH, '%Y-%m') AS a, strftime((m || '-01')::DATE - INTERVAL 23 MONTH, '%Y-%m') AS b,
        strftime((m || '-01')::DATE - INTERVAL 12 MONTH, '%Y-%m') AS c FROM m), g AS (SELECT ngram, sum((month BETWEEN a AND m)::INT) AS now, sum((month BETWEEN b AND c)::INT) AS previous FROM grams, w WHERE month BETWEEN b AND m GROUP BY ngram),
        t AS (SELECT sum(CASE WHEN month BETWEEN a AND m THEN greatest(len(tokens) - 1, 0) END) AS x, sum(CASE WHEN month BETWEEN b AND c THEN greatest(len(tokens) - 1, 0) END) AS y FROM spoken, w)
        SELECT ngram, now::BIGINT AS now, previous::BIGINT AS previous, round((now / x) / ((previous + 0.5) / y), 9) AS lift FROM g, t WHERE now >= 15 AND now > previous AND round((now / x) / ((previous + 0.5) / y), 9) >= 1.5 ORDER BY lift DESC, now DESC, ngram LIMIT 25"""),
    "x10_first_months": (x10_first_months, f"""WITH {SAID}, b AS (SELECT party, min(month) AS first, max(month) AS last FROM said WHERE party <> '' AND month IS NOT NULL GROUP BY party),
        s AS (SELECT *, (date_diff('month', (first || '-01')::DATE, (last || '-01')::DATE) + 1)::INTEGER AS span FROM b)
        SELECT party, first, last, span, strftime((first || '-01')::DATE - INTERVAL 1 MONTH, '%Y-%m') AS before_to, strftime((first || '-01')::DATE - to_months(span), '%Y-%m') AS before_from FROM s"""),
    "r17_month_series": (r_month_series, f"""WITH {SAID}, b AS (SELECT party, min(month) AS a, max(month) AS z FROM said WHERE party <> '' AND month IS NOT NULL GROUP BY party),
        e AS (SELECT party, strftime(unnest(generate_series((a || '-01')::TIMESTAMP, (z || '-01')::TIMESTAMP, INTERVAL 1 MONTH)), '%Y-%m') AS month FROM b), c AS (SELECT party, month, count(*) AS speeches FROM said GROUP BY ALL)
        SELECT e.party, e.month, coalesce(speeches, 0) AS speeches FROM e LEFT JOIN c ON c.party = e.party AND c.month = e.month"""),
}
QUERIES = {name: run for name, (run, _) in _ALL.items()}
SQL = {name: sql for name, (_, sql) in _ALL.items() if sql}
