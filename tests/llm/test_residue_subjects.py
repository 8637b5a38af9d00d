"""Residue and near-duplicates, components, subjects."""

import random

import pytest

from plenaria.llm import components, residue, simhash, subjects


@pytest.mark.parametrize(
    ("segment", "kind"),
    [
        ("Cher {{prenom}}, bonjour.", "slot"), ("Vous avez écrit « Cher {{prenom}} » : quel mépris !", None), ("Séance du ${commission}.", "slot"), ("«NOM DU DÉPUTÉ» a parlé.", "slot"), ("n° XXXX", "slot"), ("[à compléter]", "slot"),
        ("Un champ « à compléter » que nul ne comprend.", None), ("Je cite : « […] maintenus [sic] ».", None), ("La formule est {taux × assiette}.", None), ("La part atteint 9 % [contre 8 % l'an passé].", None), ("Lorem ipsum dolor sit amet.", "filler"),
        ("C'est du lorem ipsum : on remplit des pages sans rien dire.", None), ("bla bla bla bla", "filler"), ("Les tests, encore les tests, toujours les tests : voilà.", None), ("404 Not Found", "notice"), ("Un usager tombe sur une « erreur 404 » souvent.", None),
        ("Veuillez activer JavaScript pour afficher cette page.", "notice"), ("Le portail exige d'activer JavaScript, ce qui exclut les postes anciens.", None), ("Le serveur est en maintenance, revenez plus tard.", "notice"), ("Le site du ministère est en maintenance depuis mars.", None),
        ("Traceback (most recent call last): KeyError: 'x'", "notice"), ("{{ " + "a" * 300 + " }}", "slot"), ("[à compléter par " + "x" * 200 + "]", "slot"), ("Cher undefined, bonjour.", "slot"), ("Le débat sur null dans la salle.", "slot"), ("The value of f is undefined at zero.", None),
        ("By the null hypothesis, nothing follows.", None), ("Note de M. undefined.", "slot"), ("TODO : finir", "slot"), ("Un mot TODO ici.", None), ("Lorem ipsum", "filler"), ("aaaa bbbb cccc", "filler"), ("azerty qsdfgh wxcvbn", "filler"), ("Louis XIII, Louis III", None), ("Non, non.", None), ("L'amendement n° 500 est identique à l'amendement n° 503.", None), ("", None),
    ],
)
def test_segment_kind(segment, kind):
    assert residue.segment_kind(segment) == kind


def words(rng, n):
    return [rng.choice("un deux trois quatre cinq six sept huit neuf dix onze douze treize quatorze quinze seize".split()) + str(rng.randrange(50)) for _ in range(n)]


def test_near_duplicates_against_brute_force(spark):
    rng = random.Random(4)
    texts = []
    for _ in range(40):
        own = words(rng, 120)
        texts.append(" ".join(own))
        for _ in range(3):
            copy = list(own)
            copy[rng.randrange(120)] = "autre"
            texts.append(" ".join(copy))
    texts += ["court", "court un", "a b c d e f"]
    sets = [set(simhash.shingles(t).tolist()) for t in texts]
    want = set()
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both / max(1, len(sets[i] | sets[j])) >= simhash.SIMILARITY:
                want.add((j, i))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    found = {r["node"]: r["component"] for r in simhash.classes(df, "doc_id", "text").collect()}
    linked = sum(found.get(a) is not None and found.get(a) == found.get(b) for a, b in want)
    assert linked / len(want) >= 0.95
    assert all(found[k] // 4 == v // 4 for k, v in found.items())


def test_components(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (102, 102), (None, 3), (200, 201), (201, 202)]
    found = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(links, "a int, b int")).collect()}
    assert all(found[i] == 0 for i in range(61)) and found[101] == 100 and found[202] == 200 and 102 not in found
    assert components.connected_components(spark.createDataFrame([], "a int, b int")).count() == 0


def test_labels_reach_variants_but_not_genuine_copies(spark):
    rng = random.Random(5)
    body = " ".join(words(rng, 80)) + "."
    page = "La rubrique demandée se trouve momentanément fermée au public. " * 6
    rows = [
        (1, body), (2, body.replace(" ", "  ", 3)), (3, body[:200] + " {{nom}}" + body[200:]), (4, page + "\n404 Not Found"), (5, page + "\n« 404 Not Found »"), (6, page + "\n404 NOT  FOUND"), (7, None), (8, "   "), (10, page + "\n404 Not/Found"), (4, page + "\n404 Not Found"), (9, "É" * 20_000),
    ]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, text string, kinds string")
    found = {r["doc_id"]: r for r in residue.residue(df).collect()}
    assert set(found) == {3, 4, 6, 10} and found[3]["kinds"] == ["slot"] and found[4]["trusted"]
    assert residue.segment_kind("404 Not/Found") is None and not found[10]["trusted"]
    assert residue.residue(df.limit(0)).count() == 0


SUBJECTS = {
    "mer": ["phare", "marée", "voilier", "pêche", "mouette"], "bois": ["chêne", "scierie", "bûcheron", "forêt", "mousse"], "feu": ["pompier", "sirène", "lance", "caserne", "braise"], "air": ["ballon", "hélice", "cerf-volant", "nuage", "planeur"],
    "terre": ["labour", "sillon", "charrue", "argile", "taupe"], "fer": ["enclume", "forge", "laminoir", "rivet", "soudure"], "sel": ["saunier", "marais", "salaison", "gabelle", "œillet"], "vin": ["cep", "tonneau", "vendange", "pressoir", "cuvée"],
}


def speech(rng, domain, n=8, other=None):
    said = [f"Parlons de {rng.choice(SUBJECTS[domain])} et de {rng.choice(SUBJECTS[domain])} en {rng.randrange(9)} points." for _ in range(n)]
    if other:
        said.insert(2, f"Parlons de {SUBJECTS[other][0]} un instant.")
    return [" ".join(said[:3]), " ".join([*said[3:], "La sirène de la majorité chante faux !"])]


def test_subjects_on_held_out_labels(spark):
    from datetime import datetime

    rng, rows, truth = random.Random(6), [], {}
    names = sorted(SUBJECTS)
    for sid in range(480):
        kind = sid // 8 % 6
        main = names[sid % 8]
        at = datetime(2024, 1, 1)
        if kind == 5:
            second = names[(sid + 1) % 8]
            rows.append((sid, speech(rng, main) + speech(rng, second), None, "Rappels", at))
            truth[sid] = {main, second}
        elif kind == 4:
            rows.append((sid, ["Favorable."], "Texte sur " + SUBJECTS[main][1], "Rappels", at))
            truth[sid] = {main}
        else:
            rows.append((sid, speech(rng, main, other=names[(sid + 1) % 8] if kind == 3 else None), "", "Rappels", at))
            truth[sid] = {main}
    rows += [(500, None, None, None, None), (501, [], "", "", None), (502, [None, ""], None, "Rappels", None), (None, ["phare"], None, None, None), (3, rows[3][1], "", "Rappels", datetime(2024, 2, 1))]
    said = spark.createDataFrame(rows, "sid bigint, content array<string>, dossier_title string, debate_title string, loaded_at timestamp").withColumnRenamed("x", "share")
    domains = spark.createDataFrame([(d, d, k[:2]) for d, k in SUBJECTS.items()], "domain_id string, label string, keywords array<string>")
    labels = spark.createDataFrame([(s, d) for s in range(480) if s % 5 == 0 for d in truth[s]] + [(502, None)], "sid bigint, domain_id string")
    found = {}
    for r in subjects.subjects(said, domains, labels).collect():
        found.setdefault(r["sid"], set()).add(r["domain_id"])
    held = [s for s in truth if s % 5]
    right = sum(found.get(s) == truth[s] for s in held)
    assert right / len(held) >= 0.9
    assert not {500, 501, 502, None} & set(found)
    assert subjects.subjects(said.limit(0), domains, labels).count() == 0


def test_long_texts_in_bounded_time():
    import time

    began = time.perf_counter()
    for text in ("undefined is " * 20_000, "[" * 50_000, "(" + "mot " * 50_000, "{{" * 50_000, "__A_" * 20_000, "« " * 50_000, "a" * 200_000, "Non. " * 50_000):
        residue.has_slot(residue.unquoted(text))
        [residue.segment_kind(x) for x in residue.segments(text)[:100]]
    assert time.perf_counter() - began < 30


def test_a_slot_may_hold_sentence_ends(spark):
    df = spark.createDataFrame([(1, "Bonjour {{ user.name ? user.name : x. Sinon }} fin."), (2, "Un texte. Un autre.")], "doc_id bigint, text string")
    assert [r["doc_id"] for r in residue.residue(df).collect()] == [1]


def test_labels_of_whole_pages_reach_near_copies_without_a_pattern(spark):
    rng = random.Random(8)
    page = "Veuillez réessayer " + " ".join(words(rng, 100)) + "."
    copy = page.replace("Veuillez réessayer", "Nous recommençons")
    body = " ".join(words(rng, 120))
    part = "Veuillez réessayer " + " ".join(words(rng, 5)) + ". " + body
    assert residue.segment_kind(page) == "notice" and residue.segment_kind(copy) is None
    rows = [(1, page), (2, copy), (3, f"« {copy} »"), (4, part), (5, body), (6, body + " fin")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {r["doc_id"]: r["trusted"] for r in residue.residue(df).collect()} == {1: True, 2: False, 4: True}


def test_as_many_subjects_as_reach_the_share(spark):
    from datetime import datetime

    rng, at = random.Random(16), datetime(2024, 1, 1)
    names = sorted(SUBJECTS)
    rows = [(sid, speech(rng, names[sid % 8]), None, None, at) for sid in range(320)]
    rows.append((900, speech(rng, "mer", 6) + speech(rng, "bois", 6) + speech(rng, "vin", 6), None, None, at))
    said = spark.createDataFrame(rows, "sid bigint, content array<string>, dossier_title string, debate_title string, loaded_at timestamp")
    domains = spark.createDataFrame([(d, d, k[:2]) for d, k in SUBJECTS.items()], "domain_id string, label string, keywords array<string>")
    labels = spark.createDataFrame([(s, names[s % 8]) for s in range(0, 320, 5)], "sid bigint, domain_id string")
    every = {r["domain_id"] for r in subjects.subjects(said, domains, labels, most=None).where("sid = 900").collect()}
    assert every == {"mer", "bois", "vin"}
    assert len({r["domain_id"] for r in subjects.subjects(said, domains, labels).where("sid = 900").collect()}) == 2


def pairs_near(rng, similarity, count, n=300):
    """Texts of which each two in a row have about this similarity."""
    texts = []
    while len(texts) < 2 * count:
        own = [f"m{rng.randrange(10**6)}" for _ in range(n)]
        copy, a = list(own), set(simhash.shingles(" ".join(own)).tolist())
        while True:
            copy[rng.randrange(n)] = f"a{rng.randrange(10**6)}"
            b = set(simhash.shingles(" ".join(copy)).tolist())
            now = len(a & b) / len(a | b)
            if now < similarity + 0.02:
                break
        if now >= similarity:
            texts += [" ".join(own), " ".join(copy)]
    return texts


def test_recall_at_the_least_similarity(spark):
    texts = pairs_near(random.Random(12), simhash.SIMILARITY, 300)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    found = {(r["a"], r["b"]) for r in simhash.near_duplicates(df, "doc_id", "text").collect()}
    assert sum((2 * i, 2 * i + 1) in found for i in range(300)) >= 0.9 * 300


def test_keys_grow_with_the_corpus():
    small, large = simhash.tables_for(1000), simhash.tables_for(10**8)
    assert len(small[0]) == simhash.LEAST_BITS and len(large[0]) == 27 and len(large) > len(small)


def test_many_near_copies_are_one_component(spark):
    rng = random.Random(13)
    own = words(rng, 200)
    texts = []
    for _ in range(400):
        copy = list(own)
        copy[rng.randrange(200)] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(copy))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    links = simhash.near_duplicates(df, "doc_id", "text")
    assert links.count() < 20 * 400  # not all pairs
    found = {r["node"]: r["component"] for r in components.connected_components(links).collect()}
    assert len(found) == 400 and set(found.values()) == {0}


def test_links_from_seeds_reach_whole_components(spark):
    rng = random.Random(14)
    own = words(rng, 200)
    chain = [list(own)]
    for i in range(6):
        step = list(chain[-1])
        for j in range(4):
            step[(i * 4 + j) * 7 % 200] = f"y{i}-{j}"
        chain.append(step)
    texts = [" ".join(x) for x in chain] + [" ".join(words(rng, 200)) for _ in range(20)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    full = {r["node"] for r in simhash.classes(df, "doc_id", "text").collect()}
    links = simhash.near_duplicates(df, "doc_id", "text", df.where("doc_id = 0"))
    assert {r["node"] for r in components.connected_components(links).collect()} == full >= set(range(7))
