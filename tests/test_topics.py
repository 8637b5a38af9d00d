from pyspark.sql import functions as F

import __spark_entry__ as entry
from plenaria.operators import topics


def test_pairs_of_words_and_documents_without_terms(spark):
    said = [(i, ["mer", "bleue"] if i % 2 else ["bleue", "mer"]) for i in range(80)] + [(90, ["rare"]), (91, []), (92, None)]
    df = spark.createDataFrame(said, "sid bigint, tokens array<string>")
    docs, terms = topics.tfidf_arrays(df, "sid", "tokens", 30, 1.0)
    assert sorted(terms) == ["bleue", "bleue mer", "mer", "mer bleue"]
    weights, listed = topics.factorised(docs, "sid", terms, 2, 400)
    best = {r["sid"]: r["t"] for r in weights.groupBy("sid").agg(F.max(F.struct("weight", "topic"))["topic"].alias("t")).collect()}
    assert {best[i] for i in range(0, 80, 2)} | {best[i] for i in range(1, 80, 2)} == {0, 1} and best[0] != best[1]
    assert set(best) == {*range(80), 90, 91, 92} and best[90] is best[91] is best[92] is None


def test_every_speech_has_a_row(spark):
    found = entry.queries()["x8_topics"](spark, "/root/testdata/sf0.01")
    speeches = spark.read.parquet("/root/testdata/sf0.01/speeches.parquet").where("sid is not null").select("sid").distinct()
    assert found.count() == speeches.count() and found.where("topic is not null").select("topic").distinct().count() > 12
