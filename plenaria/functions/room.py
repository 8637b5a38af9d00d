"""Stage directions: what they are, and who in the room reacts how.

A direction is read clause by clause as a row of marks (reactions, other doings, directions of aim), each a
folded word from the tables below. Nouns own the benches after them, verbs the subject before them.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame

APPLAUSE, PROTEST = "applause", "protest"

# Folded beginnings of the words that say what the room does.
NOUNS = {"applaudissement": APPLAUSE, "exclamation": PROTEST, "protestation": PROTEST, "huee": PROTEST, "rire": "other", "sourire": "other", "murmure": "other", "brouhaha": "other", "mouvement": "other", "interruption": "other", "cri": "other", "bruit": "other"}
VERBS = {"applaudi": APPLAUSE, "protest": PROTEST, "hue": PROTEST, "exclame": PROTEST, "levent": "other", "leve": "other", "tourne": "other", "quitte": "other", "designe": "other", "interpelle": "other", "rient": "other", "brandi": "other", "coupe": "other"}
AIMS = ("vers", "direction", "adresse", "intention")
AT_SPEAKER = ("orateur", "oratrice")
QUALIFIERS = ("vif", "vifs", "vives", "meme", "memes", "nombreux", "nombreuses", "quelques")
CIVILITIES = ("m", "mme", "mlle")


@dataclass
class Reaction:
    groups: set[str] = field(default_factory=set)
    every_bench: bool = False
    unnamed_benches: bool = False
    detail: list[str] = field(default_factory=list)


@dataclass(frozen=True)
class Mark:
    """A word that says what happens: ``kind`` and whether it is a ``noun``, a ``verb`` or an ``aim``."""

    kind: str
    form: str
    start: int
    end: int


_WORD = re.compile(r"[^\W\d_]+")


def _fold(word: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", word.lower()) if not unicodedata.combining(c))


def _mark(word: str) -> tuple[str, str] | None:
    for stem, kind in NOUNS.items():
        if word in (stem, stem + "s"):
            return kind, "noun"
    for stem, kind in VERBS.items():
        if word.startswith(stem) and len(word) - len(stem) <= 5:
            return kind, "verb"
    return ("aim", "aim") if word in AIMS else None


def marks(clause: str) -> list[Mark]:
    return [Mark(*found, m.start(), m.end()) for m in _WORD.finditer(clause) if (found := _mark(_fold(m[0])))]


def is_direction(text: str, bracketed: bool = True) -> bool:
    """Whether a text in brackets (or a line of its own) tells what happens in the room.

    A line does if it begins with a noun of the tables; in brackets also with a person, or with a verb of them anywhere.
    """
    words = [_fold(m[0]) for m in _WORD.finditer(text)]
    while words and words[0] in QUALIFIERS:
        words = words[1:]
    if not words:
        return False
    first = _mark(words[0])
    if first is not None and first[1] == "noun":
        return True
    return bracketed and (words[0] in CIVILITIES and len(words) > 1 or any((found := _mark(w)) is not None and found[0] != "aim" for w in words))


def _scopes(clause: str) -> Iterator[tuple[str, str]]:
    """(kind, words that say who) of each reaction of a clause to the speaker."""
    found = marks(clause)
    first_verb = next((m.start for m in found if m.form == "verb"), None)
    for i, mark in enumerate(found):
        if mark.kind not in (APPLAUSE, PROTEST):
            continue
        until = lambda j: found[j + 1].start if j + 1 < len(found) else len(clause)
        after = clause[mark.end : until(i)]
        aimed = next((clause[m.end :] for m in found[i + 1 :] if m.form == "aim"), "") if all(m.form != "noun" or m.kind in (APPLAUSE, PROTEST) for m in found[i + 1 :]) else ""
        if mark.form == "verb":
            also = after[after.find("ainsi que") :] if "ainsi que" in after else ""
            target = aimed or after.removesuffix(also)
            who = clause[:first_verb] + " " + also
            if first_verb == mark.start and (before := [m for m in found[:i] if m.form == "noun"]):
                who = clause[before[-1].end : first_verb] + " " + also
        else:
            target, j = aimed, i
            while not _benches(after) and j + 1 < len(found) and found[j + 1].form == "noun":
                j += 1
                after = clause[found[j].end : until(j)]
            who = after
        others = _benches(target) and not any(w in AT_SPEAKER for w in map(_fold, _WORD.findall(target)))
        if mark.kind == PROTEST and others or "ironi" in _fold(after if mark.form == "noun" else who):
            continue
        yield mark.kind, who


def _benches(text: str) -> bool:
    return any(_fold(w).rstrip("s") in ("banc", "groupe") for w in _WORD.findall(text))


def reactions(direction: str, groups: dict[str, str]) -> dict[str, Reaction]:
    """``applause`` and ``protest`` of a stage direction with the groups that they come from.

    A noun takes the benches after it, or those of the next noun; a verb takes the subject of its clause, and who
    is named after *ainsi que*. Ironic applause and protest aimed at others than the speaker are left
    out. ``groups`` maps labels to codes.
    """
    labels = re.compile(r"(?<![\w-])(" + "|".join(sorted(map(re.escape, groups), key=len, reverse=True)) + r")(?![\w-])") if groups else None
    out: dict[str, Reaction] = {}
    for clause in re.split(r"[–—;]|\.\s+(?=[A-ZÀ-Ý])", direction):
        clause = clause.strip(" .()[]")
        for kind, who in _scopes(clause):
            held, plain = out.setdefault(kind, Reaction()), " ".join(map(_fold, _WORD.findall(who)))
            if labels:
                held.groups |= {groups[x] for x in labels.findall(who)}
            held.every_bench |= "tous les bancs" in plain
            held.unnamed_benches |= any(f"{few} bancs" in plain and not re.search(rf"{few} bancs d(?:u|es) groupe", plain) for few in ("divers", "nombreux", "plusieurs"))
            if clause not in held.detail:
                held.detail.append(clause)
    return out


def with_reactions(df: DataFrame, key: str, direction: str, groups: dict[str, str]) -> DataFrame:
    """``key``, ``kind``, ``groups``, ``every_bench``, ``unnamed_benches`` of the directions that tell of reactions."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(k, kind, sorted(r.groups), int(r.every_bench), int(r.unnamed_benches)) for k, d in zip(batch[key], batch[direction]) for kind, r in sorted(reactions(d or "", groups).items())]
            yield pd.DataFrame(rows, columns=[key, "kind", "groups", "every_bench", "unnamed_benches"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, direction).mapInPandas(run, f"`{key}` {kind}, kind string, `groups` array<string>, every_bench int, unnamed_benches int")
