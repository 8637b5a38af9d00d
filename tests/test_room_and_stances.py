"""Reactions of the room, stage directions and announced votes."""

import pytest

from plenaria.functions import room, stances

GROUPS = {x: x.replace("-", "_") for x in ("RN", "UDR", "LFI-NFP", "EPR", "SOC", "GDR", "DR", "HOR")}


@pytest.mark.parametrize(
    ("direction", "applause", "protest"),
    [
        ("Applaudissements sur les bancs des groupes RN et UDR. – Protestations sur les bancs du groupe LFI-NFP.", {"RN", "UDR"}, {"LFI_NFP"}), ("Rires sur divers bancs.", None, None), ("M. Marc Pena applaudit.", set(), None),
        ("Les députés du groupe SOC se lèvent, applaudissent l’orateur et huent les députés des groupes RN et DR.", {"SOC"}, None), ("Applaudissements ironiques sur quelques bancs du groupe RN.", None, None),
        ("Applaudissements sur les bancs du groupe GDR – « Bravo ! » et applaudissements ironiques sur quelques bancs des groupes RN et UDR.", {"GDR"}, None), ("Applaudissements sur les bancs du groupe DR. Exclamations sur les bancs du groupe RN.", {"DR"}, {"RN"}),
        ("Exclamations sur les bancs du groupe RN et applaudissements sur les bancs du groupe HOR.", {"HOR"}, {"RN"}), ("Applaudissements et exclamations sur les bancs du groupe RN.", {"RN"}, {"RN"}), ("Applaudissements sur les bancs du groupe EPR, tournés vers les bancs du groupe RN.", {"EPR"}, None),
        ("Les députés des groupes EPR, SOC et GDR se tournent vers les tribunes et applaudissent.", {"EPR", "SOC", "GDR"}, None), ("Les députés du groupe DR applaudissent, ainsi que plusieurs députés du groupe EPR.", {"DR", "EPR"}, None),
        ("Exclamations sur les bancs des groupes EPR et HOR. – Huées sur plusieurs bancs du groupe RN", None, {"EPR", "HOR", "RN"}), ("Les députés du groupe DR protestent, ainsi que plusieurs députés du groupe EPR.", None, {"DR", "EPR"}), ("Les députés du groupe RN huent l’oratrice.", None, {"RN"}),
        ("Rires et murmures sur les bancs du groupe RN.", None, None), ("Huées sur plusieurs bancs des groupes UDR et RN à l’adresse des députés du groupe SOC.", None, None), ("Exclamations sur les bancs du groupe RN à l’adresse de l’orateur.", None, {"RN"}), ("", None, None),
    ],
)
def test_reactions(direction, applause, protest):
    found = room.reactions(direction, GROUPS)
    assert (found["applause"].groups if "applause" in found else None) == applause
    assert (found["protest"].groups if "protest" in found else None) == protest


def test_benches_without_names():
    read = lambda d, kind="applause": room.reactions(d, GROUPS)[kind]
    assert read("Applaudissements sur tous les bancs.").every_bench and read("Applaudissements sur divers bancs.").unnamed_benches
    assert not read("Applaudissements sur de nombreux bancs du groupe EPR.").unnamed_benches and read("Protestations sur divers bancs.", "protest").unnamed_benches
    assert read("Sur tous les bancs, les députés, dont beaucoup se sont levés, applaudissent longuement.").every_bench
    assert read("Applaudissements sur les bancs du groupe SOC. – Vives protestations sur les bancs du groupe RN.", "protest").detail == ["Vives protestations sur les bancs du groupe RN"]


@pytest.mark.parametrize(
    ("text", "bracketed", "line"),
    [("Applaudissements sur tous les bancs.", True, True), ("Mme Panot se lève", True, False), ("article 3 du code", False, False), ("Vifs applaudissements", True, True), ("L’orateur se tourne vers le banc", True, False), ("", False, False), ("Rires sur divers bancs", True, True), ("soit deux pour cent", False, False)],
)
def test_directions(text, bracketed, line):
    assert room.is_direction(text) is bracketed and room.is_direction(text, bracketed=False) is line


@pytest.mark.parametrize(
    ("text", "stance"),
    [
        ("Pour toutes ces raisons, nous voterons contre ce texte.", "defavorable"), ("Nous voterons donc résolument contre ce projet de loi.", "defavorable"), ("Notre groupe s’opposera à cette proposition de loi.", "defavorable"), ("Nous nous opposerons à ce texte.", "defavorable"),
        ("Nous rejetterons ce projet de loi.", "defavorable"), ("Nous voterons ce texte mais nous serons vigilants.", "favorable"), ("À titre personnel, je voterai en faveur du texte.", "favorable"), ("Notre groupe soutiendra cette proposition de loi.", "favorable"), ("Nous allons voter pour ce texte.", "favorable"),
        ("C’est pourquoi nous nous abstiendrons sur ce texte.", "abstention"), ("Notre groupe s’abstiendra donc.", "abstention"), ("Nous voterons cet amendement.", None), ("Nous voterons contre l’article 3.", None), ("Nous voterons la motion de rejet préalable.", None), ("Nous voterons contre la motion de censure.", None),
        ("Nous ne voterons pas ce texte.", None), ("Si cet amendement est adopté, nous voterons contre ce texte.", None), ("Sinon, nous voterons contre ce projet de loi.", None), ("Nous voterons ce texte ?", None), ("J’espère que nous soutiendrons unanimement ce texte.", None), ("Sous réserve de garanties, notre groupe soutiendra la proposition de loi.", None),
        ("Notre groupe laisse la liberté de vote, mais nous voterons ce texte.", None), ("Vous voterez contre ce texte, comme d’habitude.", None), ("Nous nous abstiendrons lors du vote du projet de loi. Nous voterons contre ce texte.", None), ("", None), (None, None),
    ],
)
def test_announced(text, stance):
    found = stances.announced(text, "DISC_GENERALE_1", "Un texte")
    assert (found[0] if found else None) == stance


def test_announced_in_context():
    assert stances.announced("Ce texte est injuste. Nous voterons contre ce texte. Merci.") == ("defavorable", "Nous voterons contre ce texte.")
    assert stances.announced("Nous nous abstiendrons.", "DISC_ARTICLES_1_2") is None and stances.announced("Nous nous abstiendrons sur ce texte.", "DISC_ARTICLES_1_2")[0] == "abstention"
    assert stances.announced("Sur cet amendement, nous nous abstiendrons.", "DISC_GENERALE_1") is None
    named = "Je voterai pour la proposition de loi relative aux soins palliatifs."
    assert stances.announced(named, "", "Soins – Fin de vie") is None and stances.announced(named, "", "Soins")[0] == "favorable"


def test_over_a_table(spark):
    df = spark.createDataFrame([(1, "Nous voterons contre ce texte.", None, None), (2, None, "x", "y")], "i int, t string, s string, d string")
    assert [tuple(r) for r in stances.with_stances(df, "i", "t", "s", "d").collect()] == [(1, "defavorable", "Nous voterons contre ce texte.")]
    told = spark.createDataFrame([(1, "Applaudissements sur les bancs du groupe RN."), (2, None)], "i int, d string")
    assert [tuple(r) for r in room.with_reactions(told, "i", "d", GROUPS).collect()] == [(1, "applause", ["RN"], 0, 0)]
