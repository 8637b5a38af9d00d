"""Speaker turns: labels, words, and turns against a plain fold."""

import pytest

from plenaria.llm import transcripts as t


@pytest.mark.parametrize(
    ("text", "words"),
    [
        ("00:00:26,109 --> 00:00:29,109", False), ("[0:43] [inaudible]", False), ("(9 h 01) Bien.", True), ("9h02 –", False), ("[4:26] 9h02 –", False), ("Euh, euh…", False),
        ("(Rires.)", False), ("Exclamations sur les bancs du groupe ALV.", False), ("Plusieurs députés du groupe ECT quittent l'hémicycle.", False), ("♪", False), ("—", False),
        ("<toux>", False), ("T+00:01:42 Non !", True), ("", False), ("Rires. euh…", False), ("Hum, je réponds.", True),
    ],
)
def test_has_words(text, words):
    assert t.has_words(text) is words


@pytest.mark.parametrize(
    ("label", "kind", "rest"),
    [
        ("M. le Président", "chair", None), ("LA PRÉSIDENTE", "chair", None), ("Mme la présidente de séance", "chair", None), ("Des députés du groupe FDM", "collective", None), ("Une voix sur les bancs du groupe ECT", "collective", None),
        ("Mme Ana Brun, rapporteure", "person", ("f", "ana", "brun", "")), ("M. Luc NOIR (SOL)", "person", ("m", "luc", "noir", "SOL")), ("M. Luc Noir SOL", "person", ("m", "luc", "noir", "SOL")), ("NOIR Luc", "maybe", ("", "noir", "luc", "")),
        ("Mmee Brun", "person", ("f", "", "brun", "")), ("Brun", "maybe", ("", "", "brun", "")),
    ],
)
def test_read_label(label, kind, rest):
    found = t.read_label(label)
    assert found[0] == kind and (rest is None or found[1:] == rest)


@pytest.mark.parametrize("text", ["Soyons clairs", "Les élus de Brac l'ont redit", "Hélas, les maires attendent", "Monsieur le ministre, nous vous écoutons", "", "Le 3 mai"])
def test_sentences_are_no_labels(text):
    found = t.read_label(text)
    assert found is None or found[0] == "maybe"


def test_resolve_labels():
    known = [("P1", "f", "ana", "brun"), ("P2", "m", "luc", "brun"), ("P3", "m", "guy", "martelange"), ("P4", "m", "leo", "absent")]
    labels = [("Mme Ana Brun", "", 2), ("Mme Brun", "", 1), ("M. Brun", "P2", 1), ("M. L. Brun", "", 1), ("M. Marteelange", "", 1), ("MARTELANGE Guy", "", 1), ("Premier constat", "", 4), ("M. Inconnu", "", 1), ("M. Inconu", "", 1), ("Absent", "", 1)]
    found = t.resolve_labels(labels, known)
    assert found["Mme Ana Brun"] == found["Mme Brun"] == "PP1" and found["M. Brun"] == found["M. L. Brun"] == "PP2"
    assert found["M. Marteelange"] == found["MARTELANGE Guy"] == "PP3"
    assert "Premier constat" not in found and "Absent" not in found
    assert found["M. Inconnu"] == found["M. Inconu"] and found["M. Inconnu"].startswith("N")


LINES = [
    ("S1", 1, None, None, "Bonjour."), ("S1", 2, "M. le président", "", "La séance est ouverte."), ("S1", 3, None, None, "[0:10] Mme Ana Brun : Je commence. (Rires.)"), ("S1", 4, None, None, "(Sourires.)"),
    ("S1", 5, "Mme  BRUN", None, "Je continue."), ("S1", 6, None, None, "Soyons clairs : je finis."), ("S1", 7, None, "P2", "Brun. — Je réponds."), ("S1", 7, None, "P2", "Brun. — Je réponds."), ("S1", 8, "M. Luc Brun", None, "Euh…"),
    ("S1", 9, "Des députés du groupe FDM", None, "Ah !"), ("S1", 10, "M. L. Brun", "  ", "Encore."), ("S2", 1, None, None, None), ("S2", 2, "  ", "", "M Luc Brun – Là."), (None, 1, "x", "x", "x"), ("S2", None, "x", "x", "x"),
]


def test_turns(spark):
    people = spark.createDataFrame([("P1", "Mme Ana Brun"), ("P2", "M. Luc Brun"), (None, "M. Sans Id")], "acteur_id string, full_name string")
    lines = spark.createDataFrame(LINES, "session_uid string, line_no int, speaker string, acteur_id string, raw_text string").withColumnRenamed("x", "who")
    rows = t.turns(lines, people).orderBy("session_uid", "turn_no").collect()
    assert [r["text"] for r in rows] == ["Bonjour.", "La séance est ouverte.", "Je commence. Je continue. Soyons clairs : je finis.", "Je réponds.", "Ah !", "Encore.", "Là."]
    found = [tuple(r) for r in t.turns(lines, people, text=False).orderBy("session_uid", "turn_no").collect()]
    assert found == [("S1", 1, "", 1, 1), ("S1", 2, "", 2, 2), ("S1", 3, "P1", 3, 6), ("S1", 4, "P2", 7, 7), ("S1", 5, "", 9, 9), ("S1", 6, "P2", 10, 10), ("S2", 1, "P2", 2, 2)]


def test_a_long_sitting_spans_partitions(spark):
    people = spark.createDataFrame([("P1", "Mme Ana Brun"), ("P2", "M. Luc Brun")], "acteur_id string, full_name string")
    rows, want, last = [], [], None
    for i in range(1, 4001):
        who = None if i % 3 else ("P1" if (i // 30) % 2 else "P2")
        rows.append(("S", i, None, who, f"Phrase {i}."))
        now = who or last or ""
        if not want or now != last:
            want.append(["S", len(want) + 1, now, i, i])
        last, want[-1][4] = now, i
    lines = spark.createDataFrame(rows, "session_uid string, line_no int, speaker string, acteur_id string, raw_text string")
    assert [list(r) for r in t.turns(lines, people, text=False).orderBy("turn_no").collect()] == want


def test_empty(spark):
    lines = spark.createDataFrame([], "session_uid string, line_no int, speaker string, acteur_id string, raw_text string")
    assert t.turns(lines, spark.createDataFrame([], "acteur_id string, full_name string")).count() == 0


@pytest.mark.parametrize(
    ("text", "said"),
    [
        ("[00:05:53] Notre groupe euh, a déposé 31 amendements.", "Notre groupe a déposé 31 amendements."), ("avant hein les données. [8:09]", "avant les données."), ("en (Sourires.) circuit court", "en circuit court"),
        ("Ben Salem parle, ben oui.", "Ben Salem parle oui."), ("Euh….", ""), ("", ""), ("(Rires.)", ""), ("T+00:04:44 Non !", "Non !"), ("juger pas <toux> un texte", "juger pas un texte"),
    ],
)
def test_clean(text, said):
    assert t.clean(text) == said


def test_labels_of_any_length():
    found = t.read_label("M. Jean-Pierre de la Tour du Pin Gouvernet Chabot")
    assert found[0] == "person" and found[3] == "chabot"
    long = "Mme Ana Brun, secrétaire d'État auprès du ministre " + "de la mer et des lacs, chargée de la pêche " * 5
    assert len(long) > 120 and t.read_label(long)[0] == "person"
    assert t.read_label("Des députés du groupe " + "abc " * 200)[0] == "collective"
    assert t.read_label("Nous disons que la mer est belle et grande") is None


def test_blocks_lose_no_similar_name():
    import random

    rng = random.Random(3)
    names = ["".join(rng.choice("abcdeil") for _ in range(rng.randrange(1, 9))) for _ in range(250)]
    held = t._Surnames()
    for i, n in enumerate(names):
        held.add(i, n)
    for n in names:
        assert {i for i, m in enumerate(names) if t._near(n, m) >= t.SIMILAR} <= set(held.like(n))
