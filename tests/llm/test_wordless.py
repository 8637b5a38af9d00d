from plenaria.llm import residue, simhash


def test_texts_without_words_are_linked_to_none(spark):
    body = " ".join(f"mot{i}" for i in range(60))
    rows = [(1, "………"), (2, "--------"), (3, "!!!"), (4, body), (5, body + " fin"), (6, "???")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {(r["a"], r["b"]) for r in simhash.near_duplicates(df, "doc_id", "text").collect()} == {(4, 5)}


def test_residue_beside_texts_without_words(spark):
    df = spark.createDataFrame([(1, "………"), (2, "--------"), (3, "Bonjour {{ user.name }} et merci."), (4, "???")], "doc_id bigint, text string")
    assert {r["doc_id"] for r in residue.residue(df).collect()} == {3}
