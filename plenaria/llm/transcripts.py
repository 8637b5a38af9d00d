"""Raw transcript lines into clean, ordered speaker turns."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plenaria.operators.scan import carry_scan, range_sorted
from plenaria.session import checkpoint

# --- marks, fillers and stage directions ---------------------------------------

_CLOCK = r"\d{1,2}:\d{2}(?::\d{2})?(?:[.,]\d{1,3})?"
#: Time marks, wherever they stand.
TIME = re.compile(
    rf"{_CLOCK}\s*-->\s*{_CLOCK} | [\[(<]\s*(?:T\+)?{_CLOCK}\s*[\])>] | \(\s*\d{{1,2}}\s?h(?:\s?\d{{2}})?\s*\) | T\+{_CLOCK} | (?<![\d\w])\d{{1,2}}:\d{{2}}:\d{{2}}(?:[.,]\d{{1,3}})? | (?<!\w)\d{{1,2}}\s?h\s?\d{{2}}\s*[–—-](?!\w)",
    re.X,
)
#: Signs that subtitling leaves.
SIGNS = re.compile(r"♪+|♫+|>>+|^\s*[-–—]+\s|[​﻿]")
#: Stage directions in brackets; a label's group in parentheses is read before.
BRACKETED = re.compile(r"\([^()]*\)|\[[^\[\]]*\]|<[^<>]*>|\*[^*]+\*")
#: A stage direction that stands alone, without brackets.
STANDING = re.compile(
    r"""^(?:(?:vifs|nombreux|quelques|longs)\s)?(?:applaudissements|exclamations|rires|sourires|protestations|murmures|huées|brouhaha|mouvements|mêmes\smouvements|interruptions)(?:\s(?:et\s\w+\s)?(?:sur|divers|prolongés|dans|à|au)\b.*)?\W*$
    | ^(?:(?:plusieurs|les|des|de\snombreux|quelques)\s)(?:députés|membres)\b[^:—–]*\b(?:quittent|se\slèvent|applaudissent|protestent|rient)\b[^:—–]*$ | ^(?:son|micro)\scoupé\W*$ | ^inaudible\W*$ | ^toux\W*$""",
    re.X | re.I,
)
#: Sounds that fill a pause.
FILLERS = re.compile(r"\b(?:euh+|heu+|hum+|h+m+|mm+h*|mh+|ben|bah|hein|beuh)\b", re.I)
#: Fillers with the commas around them; a capitalised one before another capital is a name.
_PAUSE = re.compile(r"(?:,\s*)?\b(?:(?i:euh+|heu+|hum+|h+m+|mm+h*|mh+|bah|hein|beuh)|ben|B(?:en|EN)(?!\s+[A-ZÀ-Ý]))\b(?:\s*[,…])*")
_BEFORE_STOP = re.compile(r"\s+([,.…])")
_PARTICLES = frozenset("de du des la le les d l van von der den di da y et".split())
_LEAD = re.compile(rf"^\s*(?:{TIME.pattern}|{SIGNS.pattern}|{BRACKETED.pattern}|{FILLERS.pattern}[\s.,…]*|[…,;])\s*", re.X | re.I)
_WORD, _WORDS = re.compile(r"\w"), re.compile(r"\w+")
_COMBINING = re.compile("[\u0300-\u036f\u1ab0-\u1aff\u1dc0-\u1dff\u20d0-\u20ff\ufe20-\ufe2f]")
_OTHER = re.compile("[^a-z0-9]+")
#: What every mark, sign or bracketed direction holds, and how directions without brackets begin.
_MARKED = re.compile(r"[\[(<*>♪♫:]|\d\s?h|^\s*[-–—]|[\u200b\ufeff]")
_DIRECTION = re.compile(r"vifs|nombreu|quelques|longs|applau|exclam|rires|sourire|protest|murmure|hu[ée]es|brouhaha|mouvement|m[êe]mes|interrupt|plusieurs|les$|des$|de$|son$|micro|inaudible|toux", re.I)
_SEPARATOR = re.compile(r"\s*(?:\.\s*[–—]|[–—](?=\s)|\s-\s|\s?:(?=\s|$))\s*")

_CHAIR = re.compile(r"^(?:(?:m|mme|monsieur|madame) )?(?:le|la) president(?:e)?(?: de (?:la )?seance)?$")
_SOME = frozenset("des un une plusieurs quelques certains divers".split())
_SPEAKERS = re.compile(r"deputee?s?|voix|membres?|orateurs?|senateurs?")
_WHERE = frozenset("sur a de du des dans".split())
_WHICH = frozenset("plusieurs divers les la l nos tous certains".split())
_BENCHES = re.compile(r"bancs?|groupes?|gauche|droite|centre|opposition|majorite|salle|tribunes")
_WHOSE = re.compile(r"l|groupes?|opposition|majorite|[a-z]{2,6}")
_CIVILITIES = {"monsieur": "m", "madame": "f", "mademoiselle": "f", "mlle": "f"}
_ROLE = re.compile(r"^(?:co |vice |premiere? |deuxieme |ancienne? )*(?:rapporteur|president|ministre|depute|secretaire|questeur|garde|charge|membre|au nom|auteur|orateur|senateur|doyen|commissaire|suppleant)")
#: String similarity from which two spellings may name one person.
SIMILAR = 0.84


def fold(text: str) -> str:
    """Lower case without accents; other signs than letters and digits are spaces."""
    plain = text if text.isascii() else _COMBINING.sub("", unicodedata.normalize("NFKD", text))
    return _OTHER.sub(" ", plain.lower()).strip()


def has_words(text: str) -> bool:
    """Whether a spoken word is left once marks, stage directions and fillers are out."""
    if _MARKED.search(text) is None:  # no marks or brackets: the first word that fills no pause decides, unless it may begin a direction
        first = next((w[0] for w in _WORDS.finditer(text) if not FILLERS.fullmatch(w[0])), None)
        if first is None or not _DIRECTION.match(first):
            return first is not None
    bare = FILLERS.sub(" ", BRACKETED.sub(" ", SIGNS.sub(" ", TIME.sub(" ", text)))).strip(" \t\n.,…–—-")
    return bool(_WORD.search(bare)) and not STANDING.match(bare)


def clean(text: str) -> str:
    """What is said: without time marks, signs, stage directions and fillers, single-spaced; ``''`` without a word."""
    if not has_words(text):
        return ""
    said = _PAUSE.sub(" ", BRACKETED.sub(" ", SIGNS.sub(" ", TIME.sub(" ", text))))
    said = _BEFORE_STOP.sub(r"\1", " ".join(said.split()))
    return said.lstrip(" ,.…–—-").rstrip(" ,–—-")


def is_collective(plain: str) -> bool:
    """Whether a folded label names several people or nobody in particular: *some* *speakers*, and perhaps on which benches."""
    words = plain.split()
    at = 1 if words and words[0] in _SOME else 0
    if not at and words[:1] == ["de"]:
        at = 2 if words[1:2] == ["tres"] else 1
        if words[at : at + 1] not in (["nombreux"], ["nombreuses"]):
            return False
        at += 1
    if not at:
        return False
    at += words[at : at + 1] in (["autre"], ["autres"])
    if at == len(words) or not _SPEAKERS.fullmatch(words[at]):
        return False
    states = {"end"}  # end: a phrase may begin; which: before its benches; benches: after one; whose: after more
    for w in words[at + 1 :]:
        after = set()
        for x in states:
            if x != "which" and w in _WHERE:
                after.add("which")
            if x == "which" and w in _WHICH:
                after.add("which")
            if x in ("which", "benches") and _BENCHES.fullmatch(w):
                after.add("benches")
            if x in ("benches", "whose") and _WHOSE.fullmatch(w):
                after.add("whose")
        states = after
    return bool(states - {"which"})


def civility_of(word: str) -> str | None:
    """``m`` or ``f`` of a civility in any spelling, ``''`` where it could be both, None if it is none."""
    plain = fold(word).replace(" ", "")
    if re.fullmatch(r"m{1,3}e{1,3}", plain):
        return "f"
    if plain in ("m", "mr"):
        return "m"
    if plain in ("mm", "mmm"):
        return ""
    if len(plain) < 4:
        return None
    return next((gender for name, gender in _CIVILITIES.items() if _near(plain, name) >= 0.85), None)


def read_label(label: str) -> tuple[str, str, str, str, str] | None:
    """Kind, civility, first names, surname, group of a speaker label; None if it can't be one.

    Kind is ``chair``, ``collective``, ``person`` (a civility or a role says so) or
    ``maybe`` (capitalised words only). A single name is a surname; with two or
    more the order isn't known, so ``first`` and ``surname`` hold the label's order.
    """
    plain = fold(label)
    if not plain:
        return None
    if _CHAIR.match(plain):
        return "chair", "", "", "", ""
    if is_collective(plain):
        return "collective", "", "", plain, ""
    group = ""
    if found := re.search(r"\(\s*([A-Za-z-]{2,12})\s*\)\s*$", label):
        group, label = found[1].upper(), label[: found.start()]
    named, _, role = label.partition(",")
    words = [w for w in re.split(r"[\s  ]+", named.strip(" .")) if fold(w)]
    civility = ""
    titled = bool(words) and (found := civility_of(words[0])) is not None
    if titled:
        civility, words = found, words[1:]
    if role.strip() and not _ROLE.match(fold(role)) or re.search(r"[!?;]|\w{3,}\.\s", label):
        return None
    if not group and len(words) > 1 and re.fullmatch(r"[A-Z]{2,5}", words[-1]) and not all(w.isupper() for w in words[:-1]):
        group, words = words[-1], words[:-1]
    if not words or len(words) > 5 and not all(w[:1].isupper() or fold(w) in _PARTICLES for w in words):
        return None  # so many words are a sentence, unless all are names
    if not titled and not all(w[:1].isupper() for w in words):
        return None
    if any(re.search(r"\d", w) for w in words):
        return None
    tokens = [fold(w).replace(" ", "") for w in words]
    kind = "person" if titled else "maybe"
    return kind, civility, " ".join(tokens[:-1]), tokens[-1], group


def _parsed(lines: DataFrame, kept: list[str]) -> DataFrame:
    """Each line with its label, whether words are left with and without a label at its head, and where they begin after it; columns ``kept`` stay."""

    def one(speaker: str | None, raw: str | None) -> tuple:
        text = raw or ""
        head = text
        while True:  # marks, signs, stage directions and fillers before a label
            cut = _LEAD.sub("", head, count=1)
            if cut == head:
                break
            head = cut
        label, kind, rest = "", "", text
        if (at := _SEPARATOR.search(head)) is not None and at.start() and not STANDING.match(head):
            if (found := read_label(head[: at.start()])) is not None:
                label, kind, rest = head[: at.start()].strip(), found[0], head[at.end() :]
        own = (speaker or "").strip("   \t")
        every = has_words(text)
        return own, label, kind, every if rest is text else has_words(rest), every, len(text) - len(rest)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [one(s if isinstance(s, str) else None, r if isinstance(r, str) else None) for s, r in zip(batch["speaker"], batch["raw_text"])]
            out = pd.DataFrame(rows, columns=["own_label", "head_label", "head_kind", "words_after", "words_all", "head_size"])
            yield pd.concat([batch[["session_uid", "line_no", "acteur_id", *kept]].reset_index(drop=True), out], axis=1)

    return lines.mapInPandas(run, "session_uid string, line_no int, acteur_id string, " + "".join(f"{c} string, " for c in kept) + "own_label string, head_label string, head_kind string, words_after boolean, words_all boolean, head_size int")


# --- who speaks ------------------------------------------------------------------


def _near(a: str, b: str) -> float:
    return 1.0 if a == b else _ratio(a, b)


@lru_cache(maxsize=200_000)
def _ratio(a: str, b: str) -> float:
    if 2 * min(len(a), len(b)) < 0.7 * (len(a) + len(b)):  # below every bound that is asked for
        return 0.0
    return SequenceMatcher(None, a, b, autojunk=False).ratio()


class _Surnames:
    """Who may fit a name: two names of similarity SIMILAR or more are equal or share a pair of letters in a row.

    (Of two such names with s letters together, 0.42 s or more stand in common runs, of which there are at most
    0.16 s + 1, so one run has two letters.)
    """

    def __init__(self) -> None:
        self.held: dict[str, list[int]] = defaultdict(list)

    @staticmethod
    def blocks(name: str) -> set[str]:
        return {f"={name}", *(name[i : i + 2] for i in range(len(name) - 1))}

    def add(self, number: int, name: str) -> None:
        for b in self.blocks(name):
            self.held[b].append(number)

    def like(self, *names: str) -> list[int]:
        return sorted({i for name in names if name for b in self.blocks(name) for i in self.held.get(b, ())})


class _People:
    """Union-find over the labels and persons of one transcript.

    A cluster has at most one known person, civility and set of full names; what
    contradicts these is never united.
    """

    def __init__(self) -> None:
        self.parent: list[int] = []
        self.person: list[str] = []
        self.civility: list[str] = []

    def add(self, person: str, civility: str) -> int:
        self.parent.append(len(self.parent))
        self.person.append(person)
        self.civility.append(civility)
        return len(self.parent) - 1

    def find(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def unite(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        if i == j:
            return True
        if self.person[i] and self.person[j] and self.person[i] != self.person[j] or self.civility[i] and self.civility[j] and self.civility[i] != self.civility[j]:
            return False
        i, j = min(i, j), max(i, j)
        self.parent[j] = i
        self.person[i] = self.person[i] or self.person[j]
        self.civility[i] = self.civility[i] or self.civility[j]
        return True


def _names_fit(first: str, surname: str, person_first: str, person_surname: str) -> float:
    """How well a label's names fit a person's, 0 if not at all. Either order is tried."""
    if not first:
        return _near(surname, person_surname) if person_surname else 0.0
    best = 0.0
    for f, s in ((first, surname), (surname, first)):
        last = _near(s, person_surname)
        if last < SIMILAR:
            continue
        if not person_first:
            best = max(best, 0.9 * last)
        elif len(f) == 1 or len(person_first) == 1:
            best = max(best, last * (0.99 if f[:1] == person_first[:1] else 0))
        elif (given := _near(f, person_first)) >= SIMILAR:
            best = max(best, (last + given) / 2)
    return best


def resolve_labels(labels: list[tuple[str, str, int]], known: list[tuple[str, str, str, str]]) -> dict[str, str]:
    """The speaker of every label of one transcript; labels that name nobody are left out.

    ``labels``: label, person given on the same line (or ``''``), number of lines.
    ``known``: persons that may speak: id, civility, first name, surname; their ids
    on lines, or a label's full name, must place them in the transcript.

    Speakers: ``P`` and a person's id, ``C`` for the chair, ``G`` and a collective's name, ``N``
    and a folded label for a person that isn't known.
    """
    lines, given = Counter(), defaultdict(Counter)
    for label, person, n in labels:
        lines[label] += n
        if person:
            given[label][person] += n
    people = {p[0]: p for p in known}
    by_full = defaultdict(list)
    for p in known:
        by_full[" ".join(sorted((p[2] + " " + p[3]).split()))].append(p)
    out: dict[str, str] = {}
    read = {label: found for label in lines if label and (found := read_label(label))}
    finder = _People()
    node: dict[str, int] = {}
    person_node: dict[str, int] = {}

    def person(pid: str) -> int:
        if pid not in person_node:
            person_node[pid] = finder.add(pid, people[pid][1] if pid in people else "")
        return person_node[pid]

    for _, pid, _ in sorted(labels, key=lambda x: x[1]):
        if pid:
            person(pid)
    order = sorted(read, key=lambda x: (-len(read[x][2]), -lines[x], x))
    exact: set[str] = set()
    for label in order:
        kind, civility, first, surname, _ = read[label]
        if kind == "chair":
            out[label] = "C"
        elif kind == "collective":
            out[label] = "G" + surname
        else:
            node[label] = finder.add("", civility)
            if len(first) > 1:
                same = [p for p in by_full.get(" ".join(sorted(f"{first} {surname}".split())), []) if not civility or not p[1] or p[1] == civility]
                if len(same) == 1 and finder.unite(person(same[0][0]), node[label]):
                    exact.add(label)
    # a person's id on the line says who a label means, unless its names say otherwise
    for label in order:
        if label in node and given[label]:
            for pid, _ in sorted(given[label].items(), key=lambda x: (-x[1], x[0])):
                _, _, first, surname, _ = read[label]
                if pid not in people or _names_fit(first, surname, people[pid][2], people[pid][3]) >= 0.7:
                    finder.unite(person(pid), node[label])
                    break
    # similar names of persons in the transcript, best fit first
    present = [people[pid] for pid in person_node if pid in people]
    fits, surnames = [], _Surnames()
    for i, p in enumerate(present):
        surnames.add(i, p[3])
    for label in order:
        if label not in node or finder.person[finder.find(node[label])]:
            continue
        kind, civility, first, surname, group = read[label]
        for p in (present[i] for i in surnames.like(first, surname)):
            if civility and p[1] and p[1] != civility:
                continue
            least = SIMILAR if kind == "person" else 0.88
            if (fit := _names_fit(first, surname, p[2], p[3])) >= least:
                fits.append((-fit, -lines[label], label, p[0]))
    for _, _, label, pid in sorted(fits):
        if not finder.person[finder.find(node[label])]:
            finder.unite(person_node[pid], node[label])
    # variants of one name whose person isn't known yet: by initials and similarity
    loose = [x for x in order if x in node and not finder.person[finder.find(node[x])] and (read[x][0] == "person" or x in exact)]
    surnames = _Surnames()
    for i, a in enumerate(loose):
        for b in (loose[j] for j in surnames.like(read[a][2], read[a][3])):
            if _names_fit(read[a][2], read[a][3], read[b][2], read[b][3]) >= SIMILAR:
                finder.unite(node[a], node[b])
        surnames.add(i, read[a][3])
    # a surname that only one known person has
    surnames = _Surnames()
    for i, p in enumerate(known):
        surnames.add(i, p[3])
    for label in order:
        if label not in node or finder.person[finder.find(node[label])]:
            continue
        kind, civility, first, surname, _ = read[label]
        fit = [p for p in (known[i] for i in surnames.like(first, surname)) if (not civility or not p[1] or p[1] == civility) and _names_fit(first, surname, p[2], p[3]) >= 0.98]
        if kind == "person" and len(fit) == 1:
            finder.unite(person(fit[0][0]), node[label])
    names = {}
    for label in sorted(node):
        root = finder.find(node[label])
        names.setdefault(root, label)
        if finder.person[root]:
            out[label] = "P" + finder.person[root]
        elif read[label][0] == "person":
            out[label] = "N" + fold(names[root])
    return out


def _speakers(parsed: DataFrame, politicians: DataFrame) -> DataFrame:
    """``session_uid``, ``label``, ``who`` of every label that names a speaker.

    Labels are counted before the shuffle, so a task gets a transcript's distinct labels, not
    its lines; persons come to it by their id, full name or surname.
    """
    labelled = parsed.select("session_uid", F.explode(F.array(F.struct(F.col("own_label").alias("label"), "acteur_id"), F.struct(F.when(F.col("own_label") == "", F.col("head_label")).otherwise("").alias("label"), "acteur_id"), F.struct(F.col("head_label").alias("label"), F.lit("").alias("acteur_id")))).alias("_l"))
    counted = labelled.select("session_uid", "_l.label", F.coalesce(F.trim("_l.acteur_id"), F.lit("")).alias("acteur_id")).where("label <> '' or acteur_id <> ''").groupBy("session_uid", "label", "acteur_id").count()

    def name_keys(label: str) -> list[str]:
        found = read_label(label)
        if found is None or found[0] not in ("person", "maybe"):
            return []
        tokens = f"{found[2]} {found[3]}".split()
        return ["f " + " ".join(sorted(tokens))] if len(tokens) > 1 else ["s " + tokens[0]]

    def keys_of(labels: pd.Series) -> pd.Series:
        return labels.map(name_keys)

    counted = checkpoint(counted.withColumn("keys", F.pandas_udf(keys_of, "array<string>")("label")))

    def person_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for pid, name in zip(batch["acteur_id"], batch["full_name"]):
                words = [w for w in re.split(r"\s+", name or "") if fold(w)]
                civility = civility_of(words[0]) if words else None
                tokens = [fold(w).replace(" ", "") for w in (words if civility is None else words[1:])]
                if not tokens:
                    continue
                first, surname = " ".join(tokens[:-1]), tokens[-1]
                for key in ("p " + pid, "f " + " ".join(sorted(tokens)), "s " + surname):
                    rows.append((key, pid, civility or "", first, surname))
            yield pd.DataFrame(rows, columns=["key", "pid", "civility", "first", "surname"])

    people = politicians.where("acteur_id is not null").select("acteur_id", "full_name").mapInPandas(person_rows, "key string, pid string, civility string, first string, surname string")
    wanted = counted.select("session_uid", F.explode(F.concat("keys", F.array(F.concat(F.lit("p "), "acteur_id")))).alias("key")).distinct()
    known = wanted.join(people, "key").select(F.col("session_uid").alias("uid"), "pid", "civility", "first", "surname").distinct()

    def resolve(key: tuple, labels: pd.DataFrame, persons: pd.DataFrame) -> pd.DataFrame:
        found = resolve_labels(list(labels[["label", "acteur_id", "count"]].itertuples(index=False, name=None)), list(persons[["pid", "civility", "first", "surname"]].itertuples(index=False, name=None)))
        return pd.DataFrame([(key[0], label, who) for label, who in sorted(found.items())], columns=["session_uid", "label", "who"])

    return counted.drop("keys").groupBy("session_uid").cogroup(known.groupBy("uid")).applyInPandas(resolve, "session_uid string, label string, who string")


# --- turns -----------------------------------------------------------------------


def _turns(batch: pd.DataFrame, state: tuple | None) -> tuple[pd.DataFrame, tuple]:
    """Turns of one sorted batch; ``state``: sitting, speaker and number of the open turn."""
    session, speaker, number = state if state is not None else (None, None, 0)
    out: list[list] = []
    texts = batch["text"] if "text" in batch else [None] * len(batch)
    for uid, line, who, text in zip(batch["session_uid"], batch["line_no"], batch["who"], texts):
        if uid != session:
            session, speaker, number = uid, None, 0
        if who is None and number == 0:
            who = ""  # lines before the first speaker are a turn of nobody
        if who is not None and (who != speaker or number == 0):
            speaker, number = who, number + 1
        if out and out[-1][0] == uid and out[-1][1] == number:
            out[-1][4] = line
            out[-1][5].append(text)
        else:
            out.append([uid, number, speaker, line, line, [text]])
    found = pd.DataFrame(out, columns=["session_uid", "turn_no", "who", "first_line", "last_line", "text"])
    if "text" in batch:
        found["text"] = [" ".join(x) for x in found["text"]]
    else:
        found = found.drop(columns="text")
    return found, (session, speaker, number)


def turns(lines: DataFrame, politicians: DataFrame, text: bool = True) -> DataFrame:
    """``session_uid``, ``turn_no``, ``acteur_id``, ``first_line``, ``last_line``, ``text`` of every turn.

    ``text`` is what is said in the turn (see :func:`clean`), lines joined by spaces; with ``text=False`` it
    is neither carried nor returned.

    Repeated lines (same sitting and number) count once. A line without sitting or
    number has no place and is left out. Lines without a spoken word count for
    nothing. The speaker is the line's ``acteur_id``, else the person its label means (in
    ``speaker``, else at the head of the text), else the speaker before; words
    before any speaker are a turn of nobody, with ``acteur_id`` ``''``, as have the chair, a
    collective and a person that isn't known. Extra columns are ignored.

    Labels of a transcript are clustered by union-find, names compared only within blocks of equal pairs of letters; a
    task gets the distinct labels of a transcript, however many lines bear them. Lines are range-sorted and turns
    numbered with carried state, so a transcript of any length is spread.
    """
    placed = lines.where("session_uid is not null and line_no is not null").select("session_uid", F.col("line_no").cast("int").alias("line_no"), "speaker", "acteur_id", "raw_text")
    once = placed.groupBy("session_uid", "line_no").agg(F.max(F.struct(F.coalesce("raw_text", F.lit("")).alias("raw_text"), "speaker", "acteur_id")).alias("_r")).select("session_uid", "line_no", "_r.*")
    parsed = checkpoint(_parsed(once, ["raw_text"] if text else []))
    who = checkpoint(_speakers(parsed, politicians))
    own = who.select("session_uid", F.col("label").alias("own_label"), F.col("who").alias("own_who"))
    head = who.select("session_uid", F.col("label").alias("head_label"), F.col("who").alias("head_who"))
    joined = parsed.join(own, ["session_uid", "own_label"], "left").join(head, ["session_uid", "head_label"], "left")
    given = F.when(F.trim("acteur_id") != "", F.concat(F.lit("P"), F.trim("acteur_id")))
    spoken = F.when(F.col("head_who").isNotNull(), F.col("words_after")).otherwise(F.col("words_all"))
    said = joined.where(spoken).select("session_uid", "line_no", F.coalesce(given, "own_who", "head_who").alias("who"), *([F.expr("substring(raw_text, if(head_who is null, 0, head_size) + 1)").alias("text")] if text else []))

    def summary(batches: Iterator[pd.DataFrame]) -> dict | None:
        state, head_uid, first_who, opened = None, None, None, False
        for batch in batches:
            if head_uid is None:
                head_uid = batch["session_uid"].iloc[0]
                opened = batch["who"].iloc[0] is None
            if first_who is None:
                named = batch.loc[(batch["session_uid"] == head_uid) & batch["who"].notna(), "who"]
                first_who = named.iloc[0] if len(named) else None
            _, state = _turns(batch, state)
        if state is None:
            return None
        return {"_head": head_uid, "_lead": first_who, "_nobody": opened, "_uid": state[0], "_who": state[1], "_number": state[2]}

    def combine(state: tuple | None, found: dict) -> tuple:
        if state is None or not found["_head"] == found["_uid"] == state[0]:
            return found["_uid"], found["_who"], found["_number"]
        if found["_lead"] is None:  # no line of the partition names a speaker
            return state
        own = found["_number"] - (1 if found["_nobody"] else 0)
        return found["_uid"], found["_who"], state[2] + own - (1 if found["_lead"] == state[1] else 0)

    def rescan(batches: Iterator[pd.DataFrame], state: tuple | None) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out, state = _turns(batch.assign(text=batch["text"].map(clean)) if text else batch, state)
            yield out

    ordered = range_sorted(said, ["session_uid", "line_no"])
    pieces = carry_scan(ordered, summary, "_head string, _lead string, _nobody boolean, _uid string, _who string, _number int", combine, rescan, "session_uid string, turn_no int, who string, first_line int, last_line int" + ", text string" * text)
    whole = pieces.groupBy("session_uid", "turn_no").agg(F.max("who").alias("who"), F.min("first_line").alias("first_line"), F.max("last_line").alias("last_line"), *([F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first_line", "text"))), lambda x: x["text"]), " ").alias("text")] if text else []))
    acteur = F.when(F.col("who").startswith("P"), F.expr("substring(who, 2)")).otherwise("")
    return whole.select("session_uid", "turn_no", acteur.alias("acteur_id"), "first_line", "last_line", *(["text"] if text else []))
