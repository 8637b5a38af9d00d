"""Containers and mixtures: nothing lost, nothing over, shares and caps kept."""

from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from plenaria.llm import mixing, packing, sizes


@given(st.lists(st.integers(1, 50), max_size=200), st.integers(50, 80))
@settings(max_examples=60, deadline=None)
def test_best_fit_holds_every_item_once(items, capacity):
    bins = packing.best_fit(items, capacity)
    assert sorted(i for b in bins for i in b) == list(range(len(items)))
    loads = [sum(items[i] for i in b) for b in bins]
    assert all(x <= capacity for x in loads)
    assert sum(x <= capacity / 2 for x in loads) <= 1


def test_best_fit_takes_the_fullest_bin():
    assert [sorted(b) for b in packing.best_fit([6, 5, 4, 3], 10)] == [[0, 2], [1, 3]]


@pytest.fixture(scope="module")
def packed(spark):
    rows = [(i, (i * 37) % 90 + 1, "x") for i in range(600)] + [(1000, 250, "x"), (1001, 0, "x"), (1002, None, "x"), (None, 5, "x"), (3, (3 * 37) % 90 + 1, "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, tokens bigint, container_id string")
    return rows, packing.pack(df, "doc_id", "tokens", 100).collect()


def test_pack_keeps_all_units(packed):
    rows, out = packed
    want = {k: n for k, n, _ in rows if k is not None and n}
    got = Counter()
    for r in out:
        got[r["doc_id"]] += r["units"]
    assert dict(got) == want
    load = Counter()
    for r in out:
        load[r["container_id"]] += r["units"]
    assert max(load.values()) <= 100
    assert sum(load.values()) / (100 * len(load)) > 0.95


def test_only_what_exceeds_the_capacity_is_split(packed):
    pieces = defaultdict(list)
    for r in packed[1]:
        pieces[r["doc_id"]].append((r["piece_no"], r["first_unit"], r["units"]))
    assert sorted(pieces[1000]) == [(1, 0, 100), (2, 100, 100), (3, 200, 50)]
    assert all(len(p) == 1 for k, p in pieces.items() if k != 1000)


def test_pack_empty_and_bad_capacity(spark):
    none = spark.createDataFrame([], "doc_id bigint, tokens bigint")
    assert packing.pack(none, "doc_id", "tokens", 10).count() == 0
    with pytest.raises(ValueError):
        packing.pack(none, "doc_id", "tokens", 0)


def test_token_counts_round_trip(spark):
    texts = ["", None, "Bonjour à tous.", "é" * 5000, "<|endoftext|>"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    found = {r["doc_id"]: r["tokens"] for r in sizes.token_counts(df).collect()}
    own = sizes.tokenizer(sizes.TOKENIZER)
    for i, t in enumerate(texts):
        ids = own.encode(t or "", add_special_tokens=False).ids
        assert found[i] == len(ids) and own.decode(ids) == (t or "")
    with pytest.raises(FileNotFoundError):
        sizes.tokenizer("/nowhere.json")


@given(st.lists(st.text(max_size=60), max_size=20))
@settings(max_examples=150, deadline=None)
def test_tokens_of_cuts_are_those_of_the_text(texts):
    count = sizes.Counter(sizes.TOKENIZER)
    assert count.cut is not None
    texts = [*texts, "  deux   blancs \n\n fin ", "l'été d'Ana n'a pas 1\u00a0234 ‘mots’…", "\r\n\t x", "x" * 3000, "<|endoftext|>", "e\u0301\u0301 \U0001f600\u200d"]
    own = sizes.tokenizer(sizes.TOKENIZER)
    assert count.of(texts) == [len(own.encode(t, add_special_tokens=False).ids) for t in texts]


def test_other_tokenizers_read_whole_texts():
    path = "/opt/tokenizers/word_bpe_49k.json"
    count, own = sizes.Counter(path), sizes.tokenizer(path)
    assert count.cut is None and count.of(["Un mot.", ""]) == [len(own.encode(t, add_special_tokens=False).ids) for t in ("Un mot.", "")]


def test_expected_copies():
    sources = {"a": (0.5, 2, 1000), "b": (0.3, 1, 10_000), "c": (0.1, 3, 0), "d": (0.1, 0, 50)}
    copies = mixing.expected_copies(sources)
    assert copies["a"] == 2 and copies["c"] == copies["d"] == 0
    assert copies["b"] * 10_000 / (copies["a"] * 1000) == pytest.approx(0.6)
    fixed = mixing.expected_copies(sources, 8000)
    assert fixed["a"] == 2 and fixed["b"] == pytest.approx(0.6)
    assert mixing.expected_copies({}) == {} and mixing.expected_copies({"a": (1.0, 2, 0)}) == {"a": 0.0}


def test_systematic_draws_floor_or_ceiling(spark):
    rows = [(i, "a", i % 40 + 1) for i in range(500)] + [(1000 + i, "b", 7) for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, tokens bigint")
    out = mixing.systematic(df, "doc_id", "source", "tokens", {"a": 0.37, "b": 2.5}).collect()
    drawn = {r["doc_id"]: r["copies"] for r in out}
    assert set(drawn.values()) <= {1, 2, 3} and all(drawn[k] in (2, 3) for k in range(1000, 1080))
    a = sum(v for k, v in drawn.items() if k < 1000)
    b = sum(v for k, v in drawn.items() if k >= 1000)
    assert abs(a - 0.37 * 500) <= 1 and abs(b - 2.5 * 80) <= 1
    assert drawn == {r["doc_id"]: r["copies"] for r in mixing.systematic(df.repartition(5), "doc_id", "source", "tokens", {"a": 0.37, "b": 2.5}).collect()}


def test_mixture_reaches_shares(spark):
    docs = [(i, "mot " * (i % 30 + 5), "a") for i in range(300)] + [(1000 + i, "mot " * 20, "b") for i in range(30)] + [(5000, "mot", None), (5001, None, "a"), (5002, "mot", "unlisted"), (None, "mot", "a"), (7, "mot " * 12, "a")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, source string")
    targets = spark.createDataFrame([("a", 0.6, 1), ("b", 0.3, 4), ("none", 0.1, 2), (None, 0.1, 2)], "source string, target_share double, max_repeats int")
    report = {r["source"]: r for r in mixing.shares(df, targets).collect()}
    assert report["a"]["actual_share"] == pytest.approx(2 / 3, abs=0.02) and report["b"]["actual_share"] == pytest.approx(1 / 3, abs=0.02)
    assert report["none"]["actual_share"] == 0 and report["b"]["most_repeats"] <= 4 and report["a"]["most_repeats"] <= 1
    rows = mixing.mixture(df, targets).collect()
    assert len(rows) == sum(r["copies"] for r in report.values())
    assert len({(r["doc_id"], r["copy_no"]) for r in rows}) == len(rows)
    assert mixing.mixture(df.limit(0), targets).count() == 0
