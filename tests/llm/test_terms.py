"""Term frequency and top terms against brute force."""

import random
from collections import Counter, defaultdict

import pytest

from plenaria.llm import terms
from plenaria.operators import skew

USES = "sid bigint, pid bigint, session_uid string, gid bigint, n int, uses int, text string"


@pytest.mark.parametrize(
    ("raw", "term"),
    [("  L’Été  ", "l'été"), ("Été doux", "été doux"), ("A B\tC", "a b c"), ("   ", None), ("", None), (None, None), ("İ", "i̇")],
)
def test_normal_term(raw, term):
    assert terms.normal_term(raw) == term


def tables(spark, seed=1, rows=3000, sids=200):
    rng = random.Random(seed)
    ngrams = [(g, 1, random.Random(g).choice(["mot", "Mot ", "MOT ", "phrase"]) + str(g // 3), g) for g in range(60)] + [(900, 1, None, 1), (901, 1, "  ", 1)]
    seen = {}
    for _ in range(rows):
        sid, gid = rng.randrange(sids), 0 if rng.random() < 0.33 else rng.choice([*range(60), 900, 901, 999])
        seen[sid, gid] = (sid, None if sid % 11 == 0 else sid % 7, f"S{sid % 5}", gid, 1, rng.choice([1, 2, 5, None]), "clash")
    uses = list(seen.values())
    uses += rng.sample(uses, 100)  # delivered twice
    uses.append((None, 1, "S1", 1, 1, 4, None))
    rng.shuffle(uses)
    return spark.createDataFrame(uses, USES), spark.createDataFrame(ngrams, "gid bigint, n int, text string, total bigint"), uses, ngrams


def brute(uses, ngrams):
    names = {g: terms.normal_term(t) for g, _, t, _ in ngrams if terms.normal_term(t)}
    once = {(s, g): (p, u, n or 0) for s, p, u, g, _, n, _ in uses if s is not None}
    count, held, groups = Counter(), defaultdict(set), defaultdict(Counter)
    for (s, g), (p, u, n) in once.items():
        if g in names:
            count[names[g]] += n
            held[names[g]].add(s)
            if p is not None:
                groups[p, u][names[g]] += n
    return count, held, groups, len({s for s, _ in once})


def test_frequency_matches_brute_force(spark):
    uses, ngrams, raw, words = tables(spark)
    count, held, _, n = brute(raw, words)
    found = {r["term"]: r for r in terms.term_frequency(uses, ngrams).collect()}
    assert set(found) == set(held)
    for term, r in found.items():
        assert (r["uses"], r["speeches"]) == (count[term], len(held[term]))
        assert r["mark"] == ("rare" if len(held[term]) <= 2 else "common" if len(held[term]) > 0.1 * n else "useful")


def test_hot_term_is_found_and_salted(spark):
    uses, _, _, _ = tables(spark, rows=6000, sids=4000)
    hot = skew.hot_keys(uses, "gid")
    assert 0 in hot and None not in hot
    rows = uses.withColumn("_salt", skew.salt("gid", uses["sid"], hot, 4)).where("gid = 0").select("_salt").distinct().count()
    assert rows == 4


def test_top_terms_match_brute_force(spark):
    uses, ngrams, raw, words = tables(spark, seed=2)
    groups = brute(raw, words)[2]
    found = defaultdict(list)
    for r in terms.top_terms(uses, ngrams, 3).orderBy("rank_no").collect():
        found[r["pid"], r["session_uid"]].append((r["term"], r["uses"] or 0))
    want = {k: sorted(c.items(), key=lambda x: (-x[1], x[0]))[:3] for k, c in groups.items() if c}
    assert {k: [t for t, _ in v] for k, v in found.items()} == {k: [t for t, _ in v] for k, v in want.items()}


def test_empty(spark):
    uses, ngrams, _, _ = tables(spark)
    assert terms.term_frequency(uses.limit(0), ngrams).count() == 0
    assert terms.top_terms(uses.limit(0), ngrams.limit(0)).count() == 0
