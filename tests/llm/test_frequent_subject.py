import random
from datetime import datetime

from plenaria.llm import subjects

#: Few words for many speeches: those of the first subject stand in a third of all speeches each.
WORDS = {"ecole": ["élèves", "cantine"], **{f"s{i}": [f"{w}{chr(97 + i)}" for w in ("phare", "sillon", "rivet", "gabelle", "cuvée")] for i in range(8)}}


def test_words_of_a_subject_on_a_third_of_the_speeches(spark):
    rng, rows, truth = random.Random(7), [], {}
    small = sorted(d for d in WORDS if d != "ecole")
    for sid in range(480):
        main = "ecole" if sid % 3 == 0 else small[sid // 3 % 8]
        truth[sid] = {main}
        said = [f"Parlons de {rng.choice(WORDS[main])} et de {rng.choice(WORDS[main])} en somme." for _ in range(8)]
        rows.append((sid, [" ".join(said)], None, "Rappels", datetime(2024, 1, 1)))
    df = spark.createDataFrame(rows, "sid bigint, content array<string>, dossier_title string, debate_title string, loaded_at timestamp")
    domains = spark.createDataFrame([(d, d, k[:1]) for d, k in WORDS.items()], "domain_id string, label string, keywords array<string>")
    labels = spark.createDataFrame([(s, d) for s in range(480) if s % 5 == 0 for d in truth[s]], "sid bigint, domain_id string")
    found = {}
    for r in subjects.subjects(df, domains, labels).collect():
        found.setdefault(r["sid"], set()).add(r["domain_id"])
    hot = [s for s in truth if s % 5 and "ecole" in truth[s]]
    rare = [s for s in truth if s % 5 and "ecole" not in truth[s]]
    for own in (hot, rare):
        assert sum(found.get(s) == truth[s] for s in own) / len(own) >= 0.9
