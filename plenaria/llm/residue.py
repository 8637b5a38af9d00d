"""Template residue, filler, error pages and script notices in texts."""

from __future__ import annotations

import gc
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plenaria.llm.components import connected_components
from plenaria.llm.simhash import WordHashes, fingerprints, near_duplicates, shingle_sets
from plenaria.session import broadcast_if_small, checkpoint, written

# --- what residue looks like --------------------------------------------------

#: Slots that a template engine or a writer left unfilled; a slot ends at its closing mark, however far that is.
#: By a sign or word that such a slot holds: only texts with it are searched.
SLOTS = {
    "{": re.compile(r"\{\{[^{}\n]+\}\}|\$\{[^{}\n]+\}|\{%[^%\n]+%\}|(?<![\w{}$])\{[A-Za-z_0-9.]+\}"),
    "<": re.compile(r"<%[^%\n]+%>|<[A-Z][A-Z0-9_]{2,}>|<\s?(?i:insérer|compléter|préciser|renseigner)\b[^<>\n]*>"),
    "[": re.compile(
        r"""\[\[[^\[\]\n]+\]\] | \[(?!SIC\]|NDLR\])[A-ZÉÈÊÀÂÎÔÛÇ][A-ZÉÈÊÀÂÎÔÛÇ0-9_]{2,}\] | \[[●•_.\ ]+(?<!\.)\] | \[object\ Object\]
        | \[[^\[\]\n]*\b(?i:compléter|insérer|préciser|renseigner|remplir)\b[^\[\]\n]*\]""",
        re.X,
    ),
    "(": re.compile(r"\([^()\n]*\b(?i:à insérer|à compléter|à préciser|à renseigner)\b[^()\n]*\)"),
    "%": re.compile(r"%\([A-Za-z_.0-9]+\)[sdif]|%[A-Z][A-Z0-9_]{2,}%"),
    "@@": re.compile(r"@@\w+@@"),
    "__": re.compile(r"__[A-Z][A-Z0-9_]*__"),
    "#": re.compile(r"\#[A-Z][A-Z0-9_]{2,}\#"),
    "$": re.compile(r"\$[A-Z][A-Z0-9_]{2,}\$"),
    "«": re.compile(r"«[A-ZÉÈÊÀÂÎÔÛÇ][A-ZÉÈÊÀÂÎÔÛÇ '’]{2,}»"),
    " NOM": re.compile(r"\bPrénom NOM\b"),
    "XX": re.compile(r"\bn° ?X{2,}\b|\bXX/XX/\w{2,4}\b"),
    "TODO": re.compile(r"\bTODO\b\s*(?::|$)", re.M),
    "FIXME": re.compile(r"\bFIXME\b\s*(?::|$)", re.M),
    "TBD": re.compile(r"\bTBD\b\s*(?::|$)", re.M),
}
#: What a template engine prints for a value that is missing. In prose that speaks of such values they are words, so they count
#: after a form of address or a label, or where the segment's other small words are French.
MISSING = re.compile(r"(?<![\w'’-])(?:undefined|NaN|null)(?![\w'’-])")
_LABELLED = re.compile(r"(?:^|\b(?:M\.|Mme|Mlle|cher|chère|dear|mr\.?|mrs\.?|ms\.?|hello|bonjour|n°|no\.?)|[:(])\s*$", re.I)
_FRENCH = frozenset("le la les l un une des du de d et à au aux en dans par pour sur avec sans ne pas que qui ce cette ces son sa ses nous vous il elle est sont".split())
_OTHERS = frozenset("the of is are was be to a an and in for with that this it by or not as if when der die das und ist ein eine von mit zu den el los las y es por con una il di che per".split())

#: Fixed phrases of filler, of error pages and of script or browser notices, in lower case: at the start of a segment, and anywhere in it.
NOTICE_STARTS = re.compile(
    r"""(?:contenu|texte|page|rubrique|section|titre)\s(?:à\svenir|en\s(?:cours\sde\s)?(?:construction|rédaction))\s?\W*$
    | (?:saisir|saisissez|insérez|entrez|tapez)\s(?:ici\s)?(?:le|la|les|votre|un|une)\s(?:texte|titre|contenu|message)
    | remplace[rz]?\sce\s(?:contenu|texte|paragraphe) | exemple\sde\s(?:paragraphe|texte|titre)\b | titre\sde\s(?:la\spage|l['’]article)\b
    | (?:http/\d(?:\.\d)?\s)?[45]\d\d\s(?:[-–—:]\s)?(?:not\sfound|forbidden|unauthorized|bad\s(?:request|gateway)|internal\s(?:server\s)?error|service\s|gateway\s|erreur|page\s|accès|too\smany)
    | http/\d(?:\.\d)?\s[45]\d\d\b | (?:erreur|error)\s[45]\d\d\b | (?:error|erreur)\s?:\s | page\s(?:introuvable|non\strouvée|not\sfound)
    | une\serreur\s(?:inattendue|interne|technique|est)\b | impossible\s(?:de\scharger|d['’]afficher)\s(?:le|la|cette|ce)\b
    | le\s(?:document|contenu|fichier)\sdemandé\sn['’]est\splus\b | accès\s(?:refusé|interdit)\s?[:.!] | access\sdenied | aucun\srésultat\sne\scorrespond
    | (?:le\s(?:serveur|site|service)\sest\s|site\s)?(?:en\smaintenance|temporairement\sindisponible)\b.*(?:revenez|réessaye[rz])
    | le\s(?:serveur|site|service)\sest\s(?:en\smaintenance|temporairement\sindisponible)\W*(?:revenez|veuillez|merci|réessayez|$)
    | service\s(?:temporairement\s)?(?:indisponible|unavailable) | (?:merci\sde|veuillez)\s(?:réessayer|recharger|actualiser|patienter|vous\sreconnecter)\b
    | (?:votre\s)?session\s(?:a\s)?expirée?\b | too\smany\srequests | request\sid\b | référence\sde\sl['’]incident\s?: | (?:php\s)?(?:fatal|parse)\serror\s?:
    | oups\b | vérification\sde\svotre\snavigateur
    | (?:veuillez|merci\sd['’]|pensez\sà|vous\sdevez)\s?(?:activer|autoriser)\s(?:le\s|les\s)?(?:javascript|scripts?|cookies)
    | chargement\s(?:du|de\sla|des|en\scours)\b.*(?:…|\.\.\.)$""",
    re.X,
)
NOTICES_WITHIN = re.compile(
    r"""\btextes?\s(?:de\s(?:démonstration|remplissage)|d['’]exemple|factices?)\b | \bne\spas\spublier\b | \bdestiné\sà\sêtre\sremplacé
    | \bcette\spage\sest\sintrouvable\b | \bla\spage\sque\svous\s(?:cherchez|demandez) | \bs['’]est\sproduite\.?$ | \bvous\sn['’]avez\spas\sl['’]autorisation\b
    | \btraceback\s\(most\srecent\scall\slast\) | \bsqlstate\[ | \buncaught\s(?:exception|\w*error)\b | \b(?:java|javax|org|com)(?:\.\w+)+(?:exception|error)\b
    | \bat\s[\w.$]+\([\w.]+\.java:\d+\) | \bn['’]êtes\spas\sun\srobot\b | \bchecking\syour\sbrowser\b
    | \bjavascript\s(?:est|is)\s(?:désactivé|requis|disabled|required)\b | \b(?:enable|turn\son|activate)\s(?:javascript|scripts?|cookies)\b
    | \brequi(?:ert|ère|res?)\s(?:l['’]exécution\sde\sscripts|javascript) | \bautorisez\sles\sscripts\b | </?noscript\b
    | \bne\sfonctionne\spas\ssans\s(?:script|javascript) | \bvotre\snavigateur\sn['’]est\s(?:pas|plus)\s(?:pris\sen\scharge|compatible|supporté)
    | \byour\sbrowser\s(?:is\snot|does\snot) | \bcette\sapplication\s(?:ne\sfonctionne\spas|nécessite)\b | ^\s*at\s[\w.$]+\(""",
    re.X,
)
#: A notice within a segment holds one of these; most segments hold none, which is cheaper to see.
HINTS = (
    "script", "texte", "publier", "remplac", "page", "produite", "autorisation", "traceback", "sqlstate", "uncaught", "exception", "error", ".java:",
    "robot", "checking", "navigateur", "browser", "cookie", "application", " at ", "at ",
)

#: Words of the pseudo-Latin filler.
LATIN = frozenset(
    "lorem ipsum dolor sit amet consectetur adipiscing adipisicing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud "
    "exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat "
    "cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum".split()
)
_LONG_LATIN = frozenset(w for w in LATIN if len(w) > 4)
#: Tokens typed to fill space; other tokens count when they run along a keyboard row or repeat one letter.
TYPED = frozenset("bla test texte foo bar toto titi blah xxx".split())
#: Rows of French and English keyboards.
ROWS = ("azertyuiop", "qsdfghjklm", "wxcvbn", "qwertyuiop", "asdfghjkl", "zxcvbnm", "qwertz")
#: Share of a text's words in residue from which the text is residue as a whole, and of its words that aren't quoted.
WHOLLY, SPOKEN = 0.5, 0.8
#: Characters of segments whose reading a task remembers; forgetting them costs time only.
REMEMBERED = 20_000_000

_SPLIT = re.compile(r"\n+|(?<=[.!?…])\s+")
_SPACE = re.compile(r"[^\S\n]+")
_SPACES = ("  ", *"\t\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")
_DIGITS, _HEXADECIMAL = re.compile(r"\d+"), re.compile(r"(?=\w*\d)[0-9a-f]+")
_QUOTED = re.compile(r"«\s[^«»\n]*\s»|“[^“”\n]*”|\"[^\"\n]*\"|« [^«»\n]*»")
_MARK = re.compile(r"[«“\"]")
_WORD = re.compile(r"\w+")


@lru_cache(maxsize=100_000)
def _typed(word: str) -> bool:
    """Whether a word is one that fingers make, not thought."""
    return word in TYPED or len(set(word)) == 1 and (len(word) > 3 or len(word) == 3 and word[0] not in "icmx") or len(word) > 3 and any(word in row for row in ROWS)


def _filler(words: list[str]) -> bool:
    n = len(words)
    if n < 2:
        return False
    kinds = set(words)
    if not kinds.isdisjoint(_LONG_LATIN) and sum([w in LATIN for w in words]) >= 0.7 * n:
        return True
    return all(map(_typed, kinds)) or len(kinds) <= 4 and n >= 8 and n >= 3 * len(kinds)


def _missing(text: str) -> bool:
    """Whether a missing value was printed into the text."""
    for found in MISSING.finditer(text):
        if _LABELLED.search(text[max(0, found.start() - 12) : found.start()]):
            return True
        before = _SPLIT.split(text[max(0, found.start() - 200) : found.start()])[-1]
        near = [w.lower() for w in _WORD.findall(before)[-6:] + _WORD.findall(text[found.end() : found.end() + 60])[:6]]
        if sum(w in _FRENCH for w in near) > sum(w in _OTHERS for w in near):
            return True
    return False


def segments(text: str) -> list[str]:
    """Lines and sentences of a whole text, single-spaced."""
    single = _SPACE.sub(" ", text) if any([x in text for x in _SPACES]) else text
    return [s for x in _SPLIT.split(single) if (s := x.strip())]


@lru_cache(maxsize=100_000)
def _numbered(word: str) -> str:
    return "0" if _HEXADECIMAL.fullmatch(word) else _DIGITS.sub("0", word)


def normal_segment(words: list[str]) -> str:
    """Words of a segment in lower case, with 0 for numbers and hexadecimal tokens."""
    return " ".join([w if w.isalpha() else _numbered(w) for w in words])


def unquoted(text: str) -> str:
    """A text without what it quotes."""
    return _QUOTED.sub(" « » ", text) if _MARK.search(text) else text


def has_slot(spoken: str) -> bool:
    """Whether an unquoted text has an unfilled slot."""
    return any([sign in spoken and pattern.search(spoken) for sign, pattern in SLOTS.items()]) or any([w in spoken for w in ("undefined", "NaN", "null")]) and _missing(spoken)


def _hinted() -> Callable[[str], bool]:
    """Whether one of HINTS stands in a text."""
    import ahocorasick

    finder = ahocorasick.Automaton()
    for h in HINTS:
        finder.add_word(h, h)
    finder.make_automaton()
    return lambda low: next(finder.iter(low), None) is not None


def prose_kind(low: str, words: list[str], hinted: Callable[[str], bool]) -> str | None:
    """``filler`` or ``notice`` of an unquoted segment in lower case and its words."""
    if NOTICE_STARTS.match(low) or hinted(low) and NOTICES_WITHIN.search(low):
        return "notice"
    return "filler" if _filler(words) else None


def segment_kind(segment: str) -> str | None:
    """``slot``, ``filler`` or ``notice`` where the segment is residue; what it only quotes is none."""
    spoken = unquoted(segment)
    low = spoken.lower()
    return "slot" if has_slot(spoken) else prose_kind(low, _WORD.findall(low), _hinted())


def _digest(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


class _Segments(dict):
    """What is known of segments: kind (quotes left out of sight), digest, number of words, their hashes."""

    def __init__(self) -> None:
        super().__init__()
        self.hashes, self.hinted = WordHashes(), _hinted()
        self.room = REMEMBERED

    def __missing__(self, segment: str) -> tuple[str | None, int, int, bytes]:
        low = segment.lower()
        words = _WORD.findall(low)
        found = (prose_kind(low, words, self.hinted), _digest(normal_segment(words)), len(words), self.hashes.of(words))
        self.room -= len(segment)
        if self.room < 0:
            self.clear()
            self.room = REMEMBERED
        self[segment] = found
        return found


def readings(documents: DataFrame, key: str, text: str) -> DataFrame:
    """What one pass over the whole texts finds, a row for each document with words or residue.

    ``same`` and ``rough`` are hashes of the text and of its segments without case, numbers and signs;
    ``kinds`` the kinds of residue; ``evidence`` digests of the filler and notices; ``wholly`` whether residue
    holds ``WHOLLY`` of the words; ``spoken`` the share of words out of quotes; ``prints`` and ``n`` as in
    :func:`plenaria.llm.simhash.text_fingerprints`.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        gc.disable()  # many small tuples without cycles
        try:
            yield from read(batches)
        finally:
            gc.enable()

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = _Segments()
        for batch in batches:
            rows, hashes, lengths = [], [], []
            for t in batch[text]:
                kinds, evidence, digests, residue_words, own, every = set(), set(), [], 0, 0, 0
                said, parts = unquoted(t), segments(t)
                for s in parts:
                    _, digest, n, hashed = known[s]
                    digests.append(digest)
                    hashes.append(hashed)
                    every += n
                for s in parts if said is t else segments(said):
                    kind, digest, n, _ = known[s]
                    own += n
                    if kind:
                        kinds.add(kind)
                        evidence.add(digest)
                        residue_words += n
                if has_slot(said):
                    kinds.add("slot")
                lengths.append(every)
                rows.append((xxhash.xxh3_128_digest(t.encode("utf-8", "surrogatepass")), xxhash.xxh3_128_digest(np.array(digests, np.int64).tobytes()), sorted(kinds), sorted(evidence), residue_words > WHOLLY * max(own, 1), own / every if every else 1.0))
            prints, n = fingerprints(*shingle_sets(np.frombuffer(b"".join(hashes), np.uint64), np.array(lengths, np.int64)), len(rows))
            out = pd.DataFrame(rows, columns=["same", "rough", "kinds", "evidence", "wholly", "spoken"])
            yield out.assign(**{key: batch[key].to_numpy(), "prints": list(prints), "n": n})[[key, "same", "rough", "kinds", "evidence", "wholly", "spoken", "prints", "n"]]

    kind = documents.schema[key].dataType.simpleString()
    return documents.select(key, text).mapInPandas(run, f"`{key}` {kind}, same binary, rough binary, kinds array<string>, evidence array<bigint>, wholly boolean, spoken double, prints array<bigint>, n bigint")


def _segment_digests(texts: DataFrame, key: str, text: str) -> DataFrame:
    """``key``, ``digest`` of every segment that isn't wholly quoted."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = {(k, _digest(n)) for k, t in zip(batch[key], batch[text]) for s in segments(unquoted(t)) if (n := normal_segment(_WORD.findall(s.lower())))}
            yield pd.DataFrame(list(rows), columns=[key, "digest"])

    kind = texts.schema[key].dataType.simpleString()
    return texts.mapInPandas(run, f"`{key}` {kind}, digest bigint")


def residue(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``kinds`` and ``trusted`` of every document that holds residue.

    1. One pass reads each whole text: trusted labels (slots, filler or notices that aren't quoted) and SimHashes.
       Texts equal but for case, numbers and signs form a class; one stands for all as to near-duplicates.
    2. Classes with trusted filler or notices are the seeds: their near-duplicates are found by partitioned
       SimHash tables, verified by Hamming distance and by Jaccard similarity (five words, 0.8), then the
       near-duplicates of those, until the components of all seeds are whole.
    3. Labels go through the connected components to texts without one (``trusted`` is then false): to all
       that speak for themselves (not in quotes) where a text of the component is residue as a whole, else to
       those that hold, unquoted, a segment that is trusted filler or a trusted notice in the component. A near-copy
       of a text with a slot, but without that slot, is a genuine text.

    Documents with null or blank text are no cases; repeated keys count once for each
    distinct text; other columns are ignored; an empty table gives an empty result.
    """
    own = documents.select(F.col(key), F.col(text).alias("_text")).where(F.col(key).isNotNull() & (F.trim("_text") != ""))
    read = written(readings(own, key, "_text"))
    ones = read.groupBy("same").agg(F.min(key).alias("_one"), F.first("rough").alias("rough"), F.first("kinds").alias("kinds"), F.first("evidence").alias("evidence"), F.first("wholly").alias("wholly"), F.first("spoken").alias("spoken"))
    labelled = F.arrays_overlap("kinds", F.array(F.lit("filler"), F.lit("notice")))
    groups = checkpoint(read.where("n > 0").groupBy("rough").agg(F.min(F.struct(F.col(key), "prints", "n")).alias("_r"), F.max(labelled).alias("_seed")))
    heads = groups.select(F.col(f"_r.{key}").alias(key), "_r.prints", "_r.n")
    links = near_duplicates(own, key, "_text", groups.where("_seed").select(F.col(f"_r.{key}").alias(key)), heads)
    component = connected_components(links)
    held = groups.select("rough", F.col(f"_r.{key}").alias("node"), "_seed").join(component, "node", "left").where(F.col("_seed") | F.col("component").isNotNull())
    texts = checkpoint(ones.join(broadcast_if_small(held.select("rough", F.coalesce("component", "node").alias("_component"))), "rough", "left").drop("rough"))
    trusted = texts.where(F.size("kinds") > 0)
    seeds = trusted.where(labelled & F.col("_component").isNotNull())
    shared = seeds.select("_component", F.explode("evidence").alias("digest"), "kinds").groupBy("_component", "digest").agg(F.max("kinds").alias("kinds"))
    whole = seeds.where("wholly").groupBy("_component").agg(F.max("kinds").alias("kinds"))
    reached = texts.where((F.size("kinds") == 0) & F.col("_component").isNotNull()).select("same", "_one", "_component", "spoken")
    as_whole = reached.where(F.col("spoken") >= SPOKEN).join(whole, "_component").select("same", "kinds")
    digests = _segment_digests(own.join(broadcast_if_small(reached.select(F.col("_one").alias(key)).distinct()), key, "left_semi"), key, "_text")
    confirmed = digests.join(reached.select("same", F.col("_one").alias(key), "_component"), key).join(shared, ["_component", "digest"]).select("same", "kinds")
    found = trusted.select("same", "kinds", F.lit(True).alias("trusted")).unionByName(as_whole.unionByName(confirmed).groupBy("same").agg(F.max("kinds").alias("kinds")).withColumn("trusted", F.lit(False)))
    return read.select(key, "same").distinct().join(broadcast_if_small(checkpoint(found)), "same").groupBy(key, "same").agg(F.max("kinds").alias("kinds"), F.max("trusted").alias("trusted")).drop("same")
