"""Periods, attributions, numbering, merged phrases and last deliveries."""

from datetime import datetime

import pytest

from plenaria.functions.periods import Period, presets
from plenaria.functions.speech import Rule
from plenaria.operators import ranks, scan
from plenaria.operators.attribution import attributed
from plenaria.session import broadcast_if_small, written
from plenaria.sources.tables import last_delivered


def test_periods():
    archive = Period("2019-11", "2025-07")
    assert Period("2018-01", "2020-02").within(archive) == Period("2019-11", "2020-02") and Period("2030-01", "2030-02").within(archive) is None
    assert presets(archive) == {"all": archive, "year": Period("2024-08", "2025-07"), "quarter": Period("2025-05", "2025-07"), "session": Period("2024-10", "2025-07")}
    assert presets(Period("2025-06", "2025-10"))["session"] == Period("2025-10", "2025-10")
    for bad in (("2024-13", "2025-01"), ("2024-1", "2025-01"), ("2025-02", "2025-01"), ("", "2025-01")):
        with pytest.raises(ValueError):
            Period(*bad)


def test_attributions(spark):
    rules = [Rule("soins", "soins palliatifs"), Rule("ecole", "lycees"), Rule("cantines", "cantines"), Rule("prix", "prix du lait"), Rule("eau", "eau")]
    parents = {"soins": "sante", "ecole": "education", "cantines": "education"}
    filler = " mot" * 20
    rows = [(1, "soins palliatifs", "lycees lycees lycees" + filler), (2, "rappels", "lycees lycees lycees cantines cantines cantines" + filler), (3, "eau soins palliatifs lycees prix du lait", "rien" + filler), (4, None, None), (5, "", "lycees une fois" + filler), (6, "lycees et cantines", "")]
    df = spark.createDataFrame(rows, "sid bigint, titles string, t string")
    found = {(r["sid"], r["theme"], r["method"], r["hits"], r["level"]) for r in attributed(df, "sid", "titles", "t", rules, parents).collect()}
    assert found == {
        (1, "soins", "debate", 0, "theme"), (1, "sante", "debate", 0, "domain"), (2, "ecole", "text", 3, "theme"), (2, "cantines", "text", 3, "theme"), (2, "education", "text", 6, "domain"),
        (6, "ecole", "debate", 0, "theme"), (6, "cantines", "debate", 0, "theme"), (6, "education", "debate", 0, "domain"),
    }
    assert attributed(df.limit(0), "sid", "titles", "t", rules, parents).count() == 0


def test_numbered(spark):
    df = spark.createDataFrame([(i * 7919 % 101, "x") for i in range(101)], "n int, t string")
    found = {r["n"]: r["place"] for r in scan.numbered(df, ["n"], "place").collect()}
    assert found == {i: i + 1 for i in range(101)} and scan.numbered(df.limit(0), ["n"], "place").count() == 0


def test_a_phrase_gives_way_to_the_longer_one_or_beats_it(spark):
    rows = [("g", "loi", 100, 1), ("g", "loi de finances", 40, 3), ("g", "de finances", 60, 2), ("g", "projet de loi", 60, 3), ("h", "a b", 5, 2), ("h", "a b", 5, 2), ("h", "b a", 5, 2)]
    df = spark.createDataFrame(rows, "g string, w string, c int, n int")
    out = [(r["g"], r["w"]) for r in ranks.merged_phrases(df.distinct(), "g", "w", "c", "n", 5).orderBy("g", "pick").collect()]
    assert out == [("g", "projet de loi"), ("h", "a b"), ("h", "b a")]  # "loi" beats "loi de finances", which beats "de finances", and falls to "projet de loi"
    assert ranks.merged_phrases(df.limit(0), "g", "w", "c", "n", 5).count() == 0


def test_too_many_pairs_are_refused(spark):
    df = spark.range(100_001).selectExpr("id AS a", "id AS b", "1.0 AS s")
    with pytest.raises(ValueError):
        list(ranks.one_to_one(df, "a", "b", "s"))


def test_last_delivered(spark):
    at = [datetime(2024, 1, d) for d in (1, 2)]
    rows = [(1, "a", at[0]), (1, "b", at[1]), (2, "c", at[0]), (3, "d", at[0]), (3, "d", at[0]), (4, "e", None), (4, "f", None), (5, None, None)]
    df = spark.createDataFrame(rows, "k int, v string, at timestamp")
    found = sorted((r["k"], r["v"] or "") for r in last_delivered(df, "k", "at").collect())
    assert found[:3] == [(1, "b"), (2, "c"), (3, "d")] and [k for k, _ in found] == [1, 2, 3, 4, 5]


def test_broadcast_is_bounded_by_rows_and_bytes(spark):
    def hinted(df):
        return "ResolvedHint" in df._jdf.queryExecution().analyzed().toString() or "hint" in df._jdf.queryExecution().logical().toString().lower()

    small = spark.range(10)
    assert hinted(broadcast_if_small(small)) and not hinted(broadcast_if_small(small, limit=5))
    long = spark.range(10).selectExpr("repeat('x', 1000) AS t", "array(id) AS l")
    assert hinted(broadcast_if_small(long)) and not hinted(broadcast_if_small(long, most_bytes=5000))


def test_written(spark):
    df = spark.createDataFrame([(1, [1.0], None), (2, [], "x")], "a int, b array<double>, c string")
    assert sorted(written(df).collect()) == sorted(df.collect())
