"""Announced votes: what a speaker says that their group will do with a bill.

A sentence is read as folded words by a small grammar: who speaks, the verb, how it is turned, and what it is about.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame

from plenaria.functions.speech import sentence_spans

FAVOURABLE, UNFAVOURABLE, ABSTENTION = "favorable", "defavorable", "abstention"

# Folded words of the grammar.
SPEAKERS = {"je": 1, "j": 1, "nous": 1, "notre groupe": 2, "mon groupe": 2}
FUTURE = ("ons", "ai", "a", "ont")
STEMS = {"voter": "vote", "soutiendr": FAVOURABLE, "approuver": FAVOURABLE, "adopter": FAVOURABLE, "rejetter": UNFAVOURABLE, "refuser": UNFAVOURABLE, "opposer": "oppose", "abstiendr": ABSTENTION}
INFINITIVES = {"voter": "vote", "soutenir": FAVOURABLE, "approuver": FAVOURABLE, "adopter": FAVOURABLE, "rejeter": UNFAVOURABLE, "refuser": UNFAVOURABLE, "opposer": "oppose", "abstenir": ABSTENTION}
GOING = ("allons", "vais", "va")
REFLEXIVE = ("nous", "m", "s", "me", "se")
SMALL = ("ce", "cet", "cette", "le", "la", "l", "les", "du", "au", "votre", "notre", "de", "a", "present", "presente")
BILLS = ("texte", "budget", "loi", "projet de loi", "proposition de loi", "proposition de resolution")
OTHERS = ("amendement", "amendements", "article", "articles", "motion", "alinea")
CONDITIONS = ("si", "s il", "s ils", "sinon", "sauf", "a moins", "pourvu", "faute de", "sous reserve", "liberte de vote", "hesite", "hesitons", "pourrions", "pourrais", "devrions", "voudrions", "aurions", "aurais")
WISHES = ("espere", "esperons", "souhaite", "souhaitons", "invite", "invitons", "appelle", "appelons", "demande", "demandons", "propose", "proposons", "voudrais", "aimerais")
AFTER_NEGATION = ("pas", "jamais", "plus", "point")
NAMING = ("relatif", "relative", "visant", "portant", "tendant", "pour", "sur")
VOTE_SECTIONS = ("DISC_GENERALE", "EXPL_VOTE", "VOTE")


def folded(text: str) -> list[str]:
    plain = "".join(c for c in unicodedata.normalize("NFKD", text.lower()) if not unicodedata.combining(c))
    return "".join(c if c.isalnum() else " " for c in plain).split()


def _phrase_at(words: list[str], at: int, phrase: str) -> int:
    """Words of ``phrase`` if it stands at a place, else 0."""
    parts = phrase.split()
    return len(parts) if words[at : at + len(parts)] == parts else 0


def _holds(words: list[str], phrases: tuple[str, ...]) -> bool:
    return any(_phrase_at(words, i, p) for p in phrases for i in range(len(words)))


def _verb(words: list[str], at: int) -> tuple[str, int] | None:
    """What the verb after a speaker says, and the place after it."""
    if words[at : at + 1] and words[at] in REFLEXIVE:
        at += 1
    if at < len(words) and words[at] in GOING:
        at += 1
        if at < len(words) and words[at] in REFLEXIVE:
            at += 1
        return (INFINITIVES[words[at]], at + 1) if at < len(words) and words[at] in INFINITIVES else None
    if at < len(words):
        for stem, sense in STEMS.items():
            if words[at].startswith(stem) and words[at][len(stem) :] in FUTURE:
                return sense, at + 1
    return None


@dataclass(frozen=True)
class Object:
    """What the verb is about: the place after it, and whether the bill is named by its matter."""

    end: int
    named: bool


def _bill(words: list[str], at: int) -> Object | None:
    """A bill that stands at a place after small words."""
    while at < len(words) and words[at] in SMALL and not any(_phrase_at(words, at, b) for b in BILLS):
        at += 1
    size = max((_phrase_at(words, at, b) for b in BILLS), default=0)
    return Object(at + size, words[at + size : at + size + 1] != [] and words[at + size] in NAMING) if size else None


def sentence_stance(sentence: str, section: str = "", joint: bool = False) -> str | None:
    """The vote that one sentence announces.

    Questions, conditions, wishes, denials and what others will do announce nothing; nor do votes on
    amendments, articles and motions. An abstention without an object counts in discussions of the whole
    bill. In a joint debate a bill named by its matter could be either, and announces nothing.
    """
    words = folded(sentence)
    if "?" in sentence or _holds(words, CONDITIONS):
        return None
    for i in range(len(words)):
        size = max((_phrase_at(words, i, s) for s in SPEAKERS), default=0)
        found = _verb(words, i + size) if size else None
        if found is None or any(w in WISHES for w in words[:i]) or words[i - 1 : i] == ["ne"]:
            continue
        sense, at = found
        if words[at : at + 1] and words[at] in AFTER_NEGATION:
            continue
        if sense == ABSTENTION:
            rest = words[at:]
            if rest[:1] == ["donc"]:
                rest = rest[1:]
            if not rest:
                if section.startswith(VOTE_SECTIONS) and not _holds(words, OTHERS):
                    return ABSTENTION
                continue
            skip = 1 if rest[0] == "sur" else 3 if rest[:3] == ["lors", "du", "vote"] else 0
            about = _bill(rest, skip) if skip else None
        else:
            turn = at
            while turn < min(at + 3, len(words)) and words[turn] not in ("contre", "pour", "en") and _bill(words, turn) is None:
                turn += 1  # adverbs
            if sense == "vote":
                sense = FAVOURABLE
                if words[turn : turn + 1] == ["contre"]:
                    sense, turn = UNFAVOURABLE, turn + 1
                elif words[turn : turn + 1] == ["pour"]:
                    turn += 1
                elif words[turn : turn + 2] == ["en", "faveur"]:
                    turn += 2
            elif sense == "oppose":
                sense = UNFAVOURABLE
            about = _bill(words, turn)
        if about is not None and not (joint and about.named):
            return sense
    return None


def announced(text: str | None, section: str = "", debate: str = "") -> tuple[str, str] | None:
    """The stance of a speech and the first sentence that announces it; None without, or where two contradict."""
    joint = " – " in debate or " - " in debate
    found: dict[str, str] = {}
    for a, b in sentence_spans(text or ""):
        if (stance := sentence_stance(text[a:b], section, joint)) is not None:
            found.setdefault(stance, text[a:b])
    return next(iter(found.items())) if len(found) == 1 else None


def with_stances(df: DataFrame, key: str, text: str, section: str, debate: str) -> DataFrame:
    """``key``, ``stance``, ``quote`` of the texts that announce a vote; nulls read as ``''``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(k, *found) for k, t, s, d in zip(batch[key], batch[text].fillna(""), batch[section].fillna(""), batch[debate].fillna("")) if (found := announced(t, s, d))]
            yield pd.DataFrame(rows, columns=[key, "stance", "quote"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text, section, debate).mapInPandas(run, f"`{key}` {kind}, stance string, quote string")
