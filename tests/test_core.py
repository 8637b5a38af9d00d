"""Core operators against brute force, and the functions' fixed answers."""

import random
import time
from collections import defaultdict
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from plenaria.functions import speech, text
from plenaria.operators import asof, intervals, lexical, lookups, ranks, state
from plenaria.sources.tables import day, end_day
from plenaria.streaming import windows

EPOCH = date(1970, 1, 1)


def test_days(spark):
    raw = ["2024-02-03", "20240203", "2024-02-03T23:59:59.000+02:00", "2024-02-03 00:00:00", " 2024-02-03 ", "", None, "9999-12-31", "2024-02-31", "x", "2024-2-3"]
    df = spark.createDataFrame(list(enumerate(raw)), "i int, d string")
    out = {r["i"]: (r["a"], r["b"]) for r in df.select("i", day("d").alias("a"), end_day("d").alias("b")).collect()}
    assert all(out[i] == (date(2024, 2, 3),) * 2 for i in range(5))
    assert all(out[i] == (None, None) for i in (5, 6, 8, 9, 10)) and out[7] == (date(9999, 12, 31), None)


def spans(seed, n, keys):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        a = rng.randrange(0, 3000)
        b = None if rng.random() < 0.01 else a + rng.randrange(-3, 40)
        rows.append((rng.choice(keys), rng.choice(["x", "y"]), EPOCH + timedelta(a), None if b is None else EPOCH + timedelta(b)))
    return rows + [(None, "x", EPOCH, EPOCH), ("a", "x", None, EPOCH), rows[0]]


def brute_periods(rows):
    held = defaultdict(list)
    for k, g, s, e in rows:
        if k is not None and s is not None and (e is None or e >= s):
            held[k, g].append(((s - EPOCH).days, intervals.OPEN if e is None else (e - EPOCH).days))
    out = set()
    for (k, g), own in held.items():
        merged = []
        for s, e in sorted(own):
            if merged and s <= merged[-1][1] + 1:
                merged[-1][1] = max(merged[-1][1], e)
            else:
                merged.append([s, e])
        as_day = lambda n: None if n >= intervals.OPEN else EPOCH + timedelta(n)
        out |= {(k, g, "period", as_day(s), as_day(e)) for s, e in merged}
        out |= {(k, g, "gap", as_day(a[1] + 1), as_day(b[0] - 1)) for a, b in zip(merged, merged[1:])}
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_periods_and_gaps(spark, seed):
    rows = spans(seed, 900, ["a", "a", "a", "b", "c"])  # one key fills more than a partition
    df = spark.createDataFrame([(*r, 1) for r in rows], "who string, what string, s date, e date, _s int")
    found = intervals.periods_and_gaps(df, ["who", "what"], "s", "e").collect()
    assert len(found) == len(set(found)) and {tuple(r) for r in found} == brute_periods(rows)
    assert intervals.periods_and_gaps(df.limit(0), ["who", "what"], "s", "e").count() == 0


def brute_then(who, when, rows):
    known = [r for r in rows if None not in (r[0], r[1], r[2], r[4]) and r[0] == who and r[4] <= when]
    latest = {}
    for _, party, s, e, k in known:
        latest[party, s] = max(latest.get((party, s), (-1, -1)), (k, e))
    live = [(-s, -k, party) for (party, s), (k, e) in latest.items() if s <= when <= e]
    return min(live)[2] if live else ""


def test_value_as_known_then(spark):
    rng = random.Random(3)
    rows = []
    for _ in range(400):
        s = rng.randrange(0, 2000)
        e = intervals.OPEN if rng.random() < 0.3 else s + rng.randrange(-20, 500)
        rows.append((rng.choice("abcd"), rng.choice(["P", "Q", "R"]), s // 100 * 100, e, s + rng.randrange(0, 400)))
    rows += rows[:20] + [(None, "P", 1, 2, 3), ("a", "P", None, 2, 3), ("a", "P", 1, 2, None)]
    events = [(i, "a" if i % 3 else rng.choice(["b", "c", "zz", None]), rng.randrange(0, 2600), "clash") for i in range(2000)] + [(9999, "a", None, None)]
    left = spark.createDataFrame(events, "sid bigint, who string, day int, valid_from string")
    right = spark.createDataFrame(rows, "who string, party string, s int, e int, k int")
    out = asof.value_then(left, right, "who", "day", "party", "s", "e", "k", "then_")
    found = {r["sid"]: r["then_"] for r in out.collect()}
    assert len(found) == len(events) and found[9999] == ""
    assert all(found[i] == ("" if who is None else brute_then(who, d, rows)) for i, who, d, _ in events if d is not None)
    assert asof.value_then(left.limit(0), right, "who", "day", "party", "s", "e", "k", "then_").count() == 0
    assert {r["then_"] for r in asof.value_then(left, right.limit(0), "who", "day", "party", "s", "e", "k", "then_").collect()} == {""}


def test_log_odds_known_values(spark):
    row = spark.range(1).select(*lexical.log_odds(F.lit(50), F.lit(1000), F.lit(60), F.lit(100_000), F.lit(6e-4)), lexical.log_odds(F.lit(5), F.lit(0), F.lit(5), F.lit(9), F.lit(0.1))[0]).first()
    from math import log, sqrt

    a = 0.6
    z = (log(50.6 / (2000 - 50.6)) - log((10 + a) / (100_000 - 10 - a))) / sqrt(1 / 50.6 + 1 / 10.6)
    assert row[0] == pytest.approx(z) and row[1] == pytest.approx((50.5 / 1000.5) / (10.5 / 99_000.5)) and row[2] is None


def test_peer_ranks_and_quantiles(spark):
    df = spark.createDataFrame([("p", 1.0), ("p", 1.0), ("p", 3.0), ("q", 2.0), ("p", None)], "g string, v double")
    out = {(r["g"], r["v"]): (r["lower"], r["higher"], r["pool"]) for r in ranks.peer_ranks(df, "v", ["g"]).collect()}
    assert out["p", 1.0] == (0, 1, 3) and out["p", 3.0] == (2, 0, 3) and out["q", 2.0] == (None, None, 1) and out["p", None] == (None, None, None)
    ten = spark.createDataFrame([("g", i) for i in range(1, 11)] + [("h", 5), ("h", 5), ("h", 7), ("h", None), ("n", None)], "g string, v int")
    out = {r["g"]: (r["a"], r["b"], r["c"]) for r in ranks.values_at(ten, ["g"], "v", {"a": ranks.nearest(0.9), "b": ranks.floored(0.1), "c": ranks.floored(1.0)}).collect()}
    assert out == {"g": (9, 2, 10), "h": (7, 5, 7)}


def test_greedy_picks(spark):
    df = spark.createDataFrame([("g", "a", "x", 1), ("g", "a", "y", 2), ("g", "b", "x", 3), ("g", "b", "y", 4)], "g string, p string, s string, o int")
    assert [(r["p"], r["s"]) for r in ranks.greedy_diverse(df, "g", ["p", "s"], ["o"], 5).orderBy("pick").collect()] == [("a", "x"), ("b", "y")]
    words = spark.createDataFrame([("g", "justice fiscale", 10, 2), ("g", "la justice fiscale", 6, 3), ("g", "justice", 12, 1), ("g", "autre mot", 3, 2)], "g string, w string, c int, n int")
    assert [r["w"] for r in ranks.merged_phrases(words, "g", "w", "c", "n", 5).orderBy("pick").collect()] == ["la justice fiscale", "autre mot"]
    pairs = spark.createDataFrame([("a", "x", 3.0), ("a", "y", 2.0), ("b", "x", 2.5), ("b", "y", 1.0)], "a string, b string, s double")
    assert list(ranks.one_to_one(pairs, "a", "b", "s")) == [("a", "x", 3.0), ("b", "y", 1.0)]


def test_longest_contained(spark):
    df = spark.createDataFrame([(1, "le budget de la marine nationale"), (2, "marines"), (3, None)], "i int, t string")
    found = {r["i"]: r["needle"] for r in lookups.longest_contained(df, "i", "t", ["marine", "marine nationale", ""]).collect()}
    assert found == {1: "marine nationale"}
    assert lookups.longest_contained(df, "i", "t", []).count() == 0


@pytest.fixture(scope="module")
def hits(spark):
    at = datetime(2024, 1, 1)
    rows = [("u", at + timedelta(seconds=s)) for s in (0, 10, 59, 60, 61, 200)] + [("v", at + timedelta(seconds=5)), (None, at)]
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id bigint, who string, at timestamp")


def test_anchored_windows(hits):
    out = [(r["who"], r["window_start"].second + 60 * r["window_start"].minute, r["hits"]) for r in state.anchored_windows(hits, "who", "at", "id", 60).orderBy("who", "window_start").collect()]
    assert out == [("u", 0, 3), ("u", 60, 2), ("u", 200, 1), ("v", 5, 1)]


def test_anchored_windows_stream(spark, hits, tmp_path):
    path = str(tmp_path / "in")
    hits.coalesce(1).write.parquet(path)
    time.sleep(1.1)  # files are read in the order of their times
    spark.createDataFrame([(99, "w", datetime(2024, 1, 2))], "id bigint, who string, at timestamp").write.mode("append").parquet(path)
    stream = spark.readStream.schema(hits.schema).option("maxFilesPerTrigger", 1).parquet(path)
    query = windows.anchored_windows(stream, "who", "at", 60).writeStream.format("memory").queryName("anchored").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    query.processAllAvailable()
    query.processAllAvailable()
    query.stop()
    out = sorted((r["who"], r["hits"]) for r in spark.table("anchored").where("who <> 'w'").collect())
    assert out == [("u", 1), ("u", 2), ("u", 3), ("v", 1)]


def test_counted_once(spark):
    at = datetime(2024, 1, 1)
    rows = [(i, "d", g, v, at + timedelta(seconds=s)) for i, (g, v, s) in enumerate([("g", "a", 0), ("g", "b", 5), ("g", "c", 6), ("g", "d", 7), ("g", "e", 8), ("g", "a", 9), ("h", "a", 10), ("g", "z", 90)])]
    df = spark.createDataFrame(rows, "id int, who string, grp string, view string, at timestamp")
    found = {r["id"]: r["counted"] for r in state.counted_once(df, "who", "grp", "view", "at", "id").collect()}
    assert [found[i] for i in range(8)] == [1, 0, 0, 0, 1, 0, 0, 1]


@pytest.mark.parametrize(("share", "digits", "shown"), [(0.9965, 0, "99,7 %"), (0.999999, 0, "99,99 %"), (0.003, 0, "0,3 %"), (1.0, 0, "100 %"), (0.0, 0, "0 %"), (0.5, 0, "50 %"), (0.12345, 1, "12,3 %"), (0.0000001, 0, "0,01 %")])
def test_percent_text(spark, share, digits, shown):
    assert spark.range(1).select(text.percent_text(F.lit(share), digits)).first()[0] == shown


def test_text_functions(spark):
    row = spark.range(1).select(
        text.words_only(F.lit("C’est l'article n° 12, 3ème alinéa : 1,5 % d’été !")), text.fold(F.lit("Été à l'œuvre")), text.fold_aligned(F.lit("É-a")), text.place_query(F.lit("St-Étienne du Cœur")), text.safe_name(F.lit("M. Élie d'Or")), text.safe_name(F.lit("???")),
        text.french_day(F.lit("Lundi 3 février 2025")).cast("string"), text.digit_runs(F.lit("n° 12 et 7")), text.iso_week(F.lit("2024-12-30").cast("date")), text.shift_month(F.lit("2024-01"), -2), text.month_span(F.lit("2023-11"), F.lit("2024-02")),
        text.ngrams(F.array(F.lit("a"), F.lit("b"), F.lit("c")), 2), text.ngrams(F.array(F.lit("a")), 2), text.shortened(F.lit("Un mot. Deux mots ici."), 10), text.constituency(F.lit("97601"), {"976": "x"})["department"], text.constituency(F.lit("2A001"))["number"],
    ).first()
    assert list(row) == ["c est l article alinéa d été", "ete a l uvre", "e a", "saint etienne du coeur", "M_Elie_d_Or", "inconnu", "2025-02-03", "12,7", "2025-W01", "2023-11", 4, ["a b", "b c"], [], "Un mot.", "x", 1]


def test_markers(spark):
    def run(column, words):
        return spark.createDataFrame([(words,)], "w string").select(column("w")).first()[0]

    assert run(speech.negations, "je ne veux pas dire que nous n avons jamais plus de temps") == ["ne veux pas", "n avons jamais", "jamais plus"]
    assert run(speech.negations, "il n y a plus de temps et il ne viendra plus") == ["ne viendra plus"]
    assert run(speech.addresses, "mes chers collègues madame la ministre mon collègue monsieur président") == ["chers collègues", "madame la ministre", "mon collègue", "monsieur président"]
    assert spark.createDataFrame([(["je", "pense"],), (["loi", "je"],), (["zut"],)], "t array<string>").select(speech.marker_kind("t")).collect() == [("stance",), ("procedure",), (None,)]


def test_sequential_readings():
    said = "M. Martin parle. C'est vrai ! Et voici la fin… d'une idée"
    assert [said[a:b] for a, b in speech.sentence_spans(said)] == ["M. Martin parle.", "C'est vrai !", "Et voici la fin…", "d'une idée"]
    assert speech.closing_sentence(said) == "d'une idée" and speech.closing_sentence("") == ""
    long = "mot " * 100 + "cible " + "mot " * 100
    cut = speech.excerpt(long, 400, 405)
    assert len(cut) <= 242 and "cible" in cut and cut[0] == cut[-1] == "…"
    book = speech.RuleBook([speech.Rule("a", "soins palliatifs"), speech.Rule("b", "soins"), speech.Rule("c", "maires", weak=True), speech.Rule("d", "loi", requires=("fin de vie",))])
    assert [r.theme for _, _, r in book.matches("les soins palliatifs et les soins")] == ["a", "b"]
    assert book.title_themes("soins palliatifs maires") == ["a", "c"]
    filler = " mot" * 12
    assert set(book.text_themes("soins palliatifs soins palliatifs maires maires maires loi loi loi" + filler)) == {"a"}
    names = speech.NameBook([(1, "Mme", "Ana", "Brunet"), (2, "M.", "Luc", "Brunet"), (3, "M.", "Guy", "Noir"), (4, "M.", "Paul", "Noir")])
    assert set(names.mentions("Mme Brunet et M. Brunet, comme Guy Noir, mais pas M. Noir.", 2)) == {1, 3}
    assert len(speech.aligned("Éà-ç")) == 4


def test_mentions_join(spark):
    people = spark.createDataFrame([(1, "Mme", "Ana", "Brunet"), (2, "M.", "Luc", "Brunet"), (3, "M.", "Guy", "Le Noir"), (4, "M.", "Paul", "Noir"), (5, "M.", "Jean", "Noir")], "pid bigint, civility string, first string, last string")
    texts = spark.createDataFrame([(7, 2, "Mme Brunet et M. Brunet, comme Guy Le Noir, mais pas M. Noir. Puis Mme Brunet."), (8, None, None)], "sid bigint, pid bigint, t string")
    found = {(r["sid"], r["target"]): r["at"] for r in speech.with_mentions(texts, "sid", "t", "pid", people).collect()}
    assert found == {(7, 1): 0, (7, 3): 31}


def test_topics(spark):
    from plenaria.operators import topics

    docs = [(i, (["mer", "phare", "port"] if i % 2 else ["bois", "scie", "clou"]) * 2 + [f"m{i % 7}"]) for i in range(60)] + [(99, [])]
    df = spark.createDataFrame(docs, "i bigint, tokens array<string>")
    rows = topics.tfidf_rows(df, "i", "tokens", 3, 0.6)
    lengths = rows.groupBy("i").agg(F.sum(F.col("weight") * F.col("weight")).alias("l")).collect()
    assert len(lengths) == 60 and all(abs(r["l"] - 1) < 1e-9 for r in lengths)
    weights, terms = topics.nmf(rows, "i", 2, 50, 6)
    assert {frozenset(t for t, _ in own[:3]) for own in terms} == {frozenset(("mer", "phare", "port")), frozenset(("bois", "scie", "clou"))}
    best = {r["i"]: r["t"] for r in weights.groupBy("i").agg(F.max(F.struct("weight", "topic"))["topic"].alias("t")).collect()}
    assert len({best[i] for i in range(0, 60, 2)}) == 1 and best[0] != best[1]
    assert topics.nmf(rows.limit(0), "i")[1] == []
