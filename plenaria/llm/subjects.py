"""Subject areas of documents: a cluster tree, its leaves' discriminative terms and mixtures."""

from __future__ import annotations

import gc
import re
import zlib
from array import array
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.ml.clustering import BisectingKMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plenaria.session import broadcast_if_small, checkpoint, written

#: Words are hashed into so many buckets: what comes to the driver has this bound at any size of the corpus.
BUCKETS = 1 << 18
#: Dimensions of the projected document vectors, those that one word touches, and leaves of the cluster tree.
DIMENSIONS, TOUCHED, LEAVES = 64, 4, 64
#: Trees grown: the first over TF-IDF vectors, each further one over terms weighed by how well they tell the leaves before apart.
TREES = 1
#: Lloyd rounds of each bisection.
ROUNDS = 3
#: Documents' worth of the whole corpus' leaf mixture in each subject's, against chance.
SMOOTH = 5.0
#: Rounds that find a term's mixture of subjects.
TERM_ROUNDS = 30
#: A sentence or title is a set phrase if at least this share of documents holds it (and at least five do) ...
SET_SHARE = 2e-4
#: ... and no subject has this share of its uses.
SET_FLAT = 0.35
#: Least share of a word's uses in one subject for the word to speak for it.
WORD_SHARE = 0.4
#: Least lead of the best subject over the next, as a logarithm, for a sentence to be about it.
MARGIN = 2.0
#: Defaults of :func:`subjects`: a subject's least share of the sentences about any, sentences of a document (without set
#: phrases) in which one is enough, and subjects of a document (None: as many as reach the share).
LEAST_SHARE, SHORT, MOST = 0.2, 3, 2
#: Characters of sentences whose reading a task remembers; forgetting them costs time only.
REMEMBERED = 20_000_000

_SPOKEN = ("words", "lengths", "prints", "kinds")
_BAG = ("bag", "tf")
_TYPES = {"words": np.int32, "lengths": np.int32, "prints": np.int64, "kinds": np.int8, "bag": np.int32, "tf": np.uint16, "hits": np.int32}
_WORD = re.compile(r"[^\W\d_]+")
_SENTENCE = re.compile(r"(?<=[.!?…])\s+|\n")
_NO_WORD = (b"", 0, 0, ())


def sentences(paragraphs) -> list[str]:
    """Sentences of all paragraphs; a paragraph's end ends one."""
    if paragraphs is None:
        return []
    return _SENTENCE.split("\n".join([p for p in paragraphs if p]))


# --- arrays ----------------------------------------------------------------------


def packed(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """A binary column whose rows hold ``sizes`` of the ``values`` each."""
    offsets = (np.concatenate(([0], np.cumsum(sizes))) * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def unpacked(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """Values of a column made by :func:`packed`, and how many each row holds."""
    found, kind = column(batch, name).cast(pa.binary()), np.dtype(_TYPES[name])
    _, offsets, data = found.buffers()
    ends = np.frombuffer(offsets, np.int32)[found.offset : found.offset + len(found) + 1]
    values = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.zeros(0, np.uint8)
    return values.view(kind), np.diff(ends) // kind.itemsize


def sums(rows: np.ndarray, columns: np.ndarray, height: int, width: int, weights: np.ndarray | None = None) -> np.ndarray:
    """A table of sums of ``weights`` (else counts) by row and column."""
    return np.bincount(rows * width + columns, weights, minlength=height * width).reshape(height, width)


def counted(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in order, and how often each occurs."""
    if not len(values):
        return values, np.zeros(0, np.int64)
    own = np.sort(values)
    starts = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
    return own[starts], np.diff(starts, append=len(own))


@dataclass
class Spoken:
    """A batch of documents as arrays: words by sentence, sentences by document."""

    documents: int
    owner: np.ndarray  # document of each sentence
    title: np.ndarray  # 0: content, 1: first title, 2: second title
    prints: np.ndarray  # fingerprint of each sentence
    words: np.ndarray  # bucket of each word, once in a sentence
    of: np.ndarray  # sentence of each word

    @classmethod
    def read(cls, batch: pa.RecordBatch) -> Spoken:
        lengths, held = unpacked(batch, "lengths")
        words = unpacked(batch, "words")[0].astype(np.int64)
        return cls(batch.num_rows, np.repeat(np.arange(batch.num_rows), held), unpacked(batch, "kinds")[0], unpacked(batch, "prints")[0], words, np.repeat(np.arange(len(lengths)), lengths))


class _Tokens(dict):
    """What ``read`` makes of a token's words; it fills itself as tokens are met."""

    def __init__(self, read: Callable[[list[str]], object]) -> None:
        super().__init__()
        self.read = read

    def __missing__(self, token: str):
        if len(self) > 500_000:
            self.clear()
        found = self[token] = self.read(_WORD.findall(token))
        return found


def _buckets(words: list[str]) -> tuple[int, ...]:
    return tuple([zlib.crc32(w.lower().encode()) % BUCKETS for w in words])


def _plain(words: list[str]) -> str:
    return "".join([f" {w.lower()}" for w in words])


def _common(words: list[str]) -> str:
    return "".join([f" {w}" for w in words if not w[0].isupper()])


def encoder(key: str, content: str, titles: list[str], keywords: list[tuple[int, str]], subjects: int):
    """A partition function from texts to arrays, with the document frequency of each bucket of words and the uses of each bucket of fingerprints at the end.

    A sentence holds the buckets of its distinct words and a fingerprint of its words in their order, those
    with a capital after the first left out (a phrase stays the same whoever or whatever place it names), unless
    these are most of them. A document's bag has the buckets of its content with the sentences that use them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()  # millions of small tuples without cycles
        try:
            yield from encoded(batches)
        finally:
            gc.enable()

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        finder, first_words = ahocorasick.Automaton(), set()
        for d, k in keywords:
            finder.add_word(k, d)
            first_words.add(_buckets(k.split())[0])
        if keywords:
            finder.make_automaton()
        buckets_of, plain_of, common_of, hash_of = _Tokens(_buckets).__getitem__, _Tokens(_plain).__getitem__, _Tokens(_common).__getitem__, xxhash.xxh64_intdigest
        known: dict[str, tuple] = {}
        room = REMEMBERED
        frequency, uses, live, kinds_of = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64), 0, None

        def read(sentence: str) -> tuple:
            """Buckets, their number, the fingerprint (another for a title, which ends in a line end), subjects of keywords."""
            nonlocal room
            tokens = sentence.split()
            if not (own := set(chain.from_iterable(map(buckets_of, tokens)))):
                return _NO_WORD
            hits = tuple([d for _, d in finder.iter("".join(map(plain_of, tokens)) + " ")]) if not own.isdisjoint(first_words) else ()
            phrase = plain_of(tokens[0]) + "".join(map(common_of, tokens[1:]))
            if 2 * phrase.count(" ") < len(tokens):
                phrase = "".join(map(plain_of, tokens))
            entry = (array("i", own).tobytes(), len(own), hash_of(f"{phrase}\n" if sentence[-1] == "\n" else phrase) - (1 << 63), hits)
            room -= len(sentence)
            if room < 0:
                known.clear()
                room = REMEMBERED
            known[sentence] = entry
            return entry

        for batch in batches:
            named = [column(batch, c).to_pylist() for c in titles]
            n, kinds_of = batch.num_rows, [column(batch, c).type for c in (key, "given")]
            entries, heads, held = [], [], []
            hits = np.zeros((n, subjects), np.int32)
            for i, paragraphs in enumerate(column(batch, content).to_pylist()):
                before = len(entries)
                for s in sentences(paragraphs):
                    entry = known.get(s) or read(s)
                    if entry[1]:
                        entries.append(entry)
                        for d in entry[3]:
                            hits[i, d] += 1
                for kind, heading in enumerate(named, 1):
                    if heading[i]:
                        entry = known.get(s := heading[i].rstrip("\n") + "\n") or read(s)
                        if entry[1]:
                            heads.append((len(entries), kind))
                            entries.append(entry)
                held.append(len(entries) - before)
            held, words, lengths, prints = np.array(held, np.int64), [e[0] for e in entries], [e[1] for e in entries], [e[2] for e in entries]
            kinds = np.zeros(len(entries), np.int8)
            for at, kind in heads:
                kinds[at] = kind
            every, sizes, titled = np.frombuffer(b"".join(words), np.int32), np.array(lengths, np.int32), kinds
            owner = np.repeat(np.arange(n), held)
            spoken = sums(owner, np.zeros(len(owner), np.int64), n, 1, sizes)[:, 0].astype(np.int64)
            said = np.repeat(titled == 0, sizes)
            pairs, counts = counted(np.repeat(owner, sizes)[said] * BUCKETS + every[said])
            bag, of = (pairs % BUCKETS).astype(np.int32), pairs // BUCKETS
            frequency += np.bincount(bag, minlength=BUCKETS)
            marks = np.array(prints, np.int64)
            uses += np.bincount(marks & (BUCKETS - 1), minlength=BUCKETS)
            in_bag = np.bincount(of, minlength=n)
            live += int((in_bag > 0).sum())
            yield pa.RecordBatch.from_pydict(
                {
                    key: column(batch, key), "given": column(batch, "given"), "words": packed(every, spoken), "lengths": packed(sizes, held), "prints": packed(marks, held),
                    "kinds": packed(titled, held), "bag": packed(bag, in_bag), "tf": packed(np.minimum(counts, 65_535).astype(np.uint16), in_bag),
                    "hits": packed(hits.ravel(), np.full(n, subjects)), "term": pa.nulls(n, pa.int32()), "held": pa.nulls(n, pa.int64()),
                }
            )
        every = np.concatenate((frequency, uses))
        at = np.flatnonzero(every)
        size = len(at) + 1
        if kinds_of is not None:
            none = {c: pa.nulls(size, kind) for c, kind in [*zip((key, "given"), kinds_of), *((c, pa.binary()) for c in _TYPES)]}
            yield pa.RecordBatch.from_pydict({**none, "term": pa.array(np.append(at, -1), pa.int32()), "held": pa.array(np.append(every[at], live), pa.int64())})

    return run


# --- the tree --------------------------------------------------------------------


def directions() -> tuple[np.ndarray, np.ndarray]:
    """The dimensions that each bucket touches and their signs, the same on every machine."""
    rng = np.random.default_rng(11)
    return rng.integers(0, DIMENSIONS, (TOUCHED, BUCKETS), np.int64), rng.choice(np.array([-1.0, 1.0]), (TOUCHED, BUCKETS))


def vectors_of(batch: pa.RecordBatch, weight: np.ndarray, where: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Normalised vectors of a batch's contents: weighed terms, projected; zero where nothing is left."""
    bag, held = unpacked(batch, "bag")
    own = weight[bag] > 0
    owner, words = np.repeat(np.arange(batch.num_rows), held)[own] * DIMENSIONS, bag[own]
    value = (1 + np.log(unpacked(batch, "tf")[0][own])) * weight[words]
    out = np.zeros(batch.num_rows * DIMENSIONS)
    for place, sign in zip(*where):
        out += np.bincount(owner + place[words], value * sign[words], minlength=len(out))
    out = out.reshape(batch.num_rows, DIMENSIONS)
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(norm > 1e-6, norm, 1)


@dataclass
class Tree:
    """Leaves of a cluster tree over vectors of weighed terms."""

    weight: np.ndarray
    centres: np.ndarray

    def leaves_of(self, batch: pa.RecordBatch, where: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """The leaf of each document, -1 for one without weighed terms."""
        own = vectors_of(batch, self.weight, where)
        near = own @ self.centres.T - 0.5 * (self.centres**2).sum(axis=1)
        return np.where(np.abs(own).sum(axis=1) > 0, near.argmax(axis=1), -1)


@dataclass
class Leaves:
    """What one pass counts about the leaves of a tree."""

    terms: DataFrame  # b, l, v: documents of leaf l with term b
    size: np.ndarray  # documents of each leaf
    hits: np.ndarray  # leaves by subjects: documents with a keyword
    given: np.ndarray  # leaves by subjects: labels


def term_mixtures(found: pd.DataFrame, size: np.ndarray, profiles: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """How well each term tells leaves apart, and its mixture of subjects.

    ``found`` holds each term's documents by leaf (``at``, ``v``). A term's spread over the leaves is
    compared with that of all documents (Kullback-Leibler, less its bias for rare terms). It
    is then explained as a mixture of the subjects' spreads (``profiles``, leaves by subjects) and that of
    all documents, by expectation maximisation.
    """
    table = np.zeros((len(found), len(size)))
    for i, (at, v) in enumerate(zip(found["at"], found["v"])):
        table[i, at] = v
    used = table.sum(axis=1, keepdims=True)
    rate = table / np.maximum(size, 1)
    share = rate / np.maximum(rate.sum(axis=1, keepdims=True), 1e-15)
    tells = (share * np.log(np.maximum(share * len(size), 1e-15))).sum(axis=1) - (np.minimum(len(size), used[:, 0]) - 1) / (2 * np.maximum(used[:, 0], 1))
    if profiles is None:
        return np.maximum(tells, 0), np.zeros((len(found), 0))
    whole = size / max(size.sum(), 1)
    spread = np.hstack([profiles, whole[:, None]])
    mix = np.full((len(found), spread.shape[1]), 1 / spread.shape[1])
    for _ in range(TERM_ROUNDS):
        mix *= (table / (mix @ spread.T + 1e-12)) @ spread
        mix /= np.maximum(mix.sum(axis=1, keepdims=True), 1e-12)
    return np.maximum(tells, 0), mix[:, :-1]


class Classifier:
    """Weights of words for subjects, from their shares of each word, and set phrases that speak for none."""

    def __init__(self, used: np.ndarray, share: np.ndarray, set_phrases: frozenset[int] = frozenset()) -> None:
        best, n = share.max(axis=1), share.shape[1]
        self.subject = share.argmax(axis=1).astype(np.int16)
        strong = (used >= 2) & (best >= WORD_SHARE)
        self.weight = np.where(strong, np.log(np.maximum(best, 1e-9) * max(n - 1, 1) / (np.maximum(1 - best, 0) + 1e-3)), 0).astype(np.float32)
        self.n = n
        self.set_phrases = np.array(sorted(set_phrases), np.int64)

    @classmethod
    def counted(cls, counts: np.ndarray, totals: np.ndarray, set_phrases: frozenset[int]) -> Classifier:
        """From uses of words in the sentences about each subject."""
        rate = (counts + 0.5 * totals / max(totals.sum(), 1e-9)) / (totals + 1)
        return cls(counts.sum(axis=1), rate / np.maximum(rate.sum(axis=1, keepdims=True), 1e-12), set_phrases)

    def sentence_subjects(self, e: Spoken) -> np.ndarray:
        """The subject of each sentence, -1 where it is about none."""
        n, count = self.n, len(e.owner)
        if count == 0:
            return np.zeros(0, np.int64)
        weight = self.weight[e.words]
        some = weight > 0
        scores = sums(e.of[some], self.subject[e.words[some]].astype(np.int64), count, n, weight[some])
        top = np.partition(scores, n - 2, axis=1) if n > 1 else np.hstack([np.zeros_like(scores), scores])
        clear = (top[:, -1] - top[:, -2] >= MARGIN) & ~np.isin(e.prints, self.set_phrases)
        return np.where(clear, scores.argmax(axis=1), -1)

    def mixtures(self, e: Spoken, found: np.ndarray) -> np.ndarray:
        """Sentences of each document's content by subject."""
        own = (e.title == 0) & (found >= 0)
        return sums(e.owner[own], found[own], e.documents, self.n)


def dealt_with(mixture: np.ndarray, lengths: np.ndarray, least_share: float, short: int, most: int | None) -> np.ndarray:
    """Which subjects a document's content deals with, as a mask of documents by subjects."""
    total = mixture.sum(axis=1, keepdims=True)
    own = (mixture >= 2) & (mixture >= least_share * total)
    brief = (total[:, 0] == 1) & (lengths <= short)
    own[brief] = mixture[brief] > 0
    if most is not None:
        order = np.argsort(-mixture, axis=1, kind="stable")[:, most:]
        np.put_along_axis(own, order, False, axis=1)
    return own


class SubjectModel:
    """The steps of :func:`subjects`.

    Texts are read once, to encode them as arrays in a table of the checkpoint folder. Every later
    pass reads the columns of it that it needs and sends sums of bounded size.
    """

    def __init__(self, documents: DataFrame, key: str, content: str, titles: list[str], domains: list[str], keywords: list[tuple[int, str]], labels: DataFrame) -> None:
        self.key, self.content, self.titles = key, content, titles
        self.domains, self.keywords = domains, keywords
        given = labels.groupBy(key).agg(F.array_sort(F.collect_set("subject")).alias("given"))
        self.documents = documents.select(key, content, *titles).join(broadcast_if_small(given), key, "left")
        self.kind = documents.schema[key].dataType.simpleString()

    def encode(self) -> None:
        """Write the documents' arrays; weigh terms by document frequency, those of a single document not at all."""
        schema = f"`{self.key}` {self.kind}, given array<int>, words binary, lengths binary, prints binary, kinds binary, bag binary, tf binary, hits binary, term int, held bigint"
        run = encoder(self.key, self.content, self.titles, self.keywords, len(self.domains))
        table = written(self.documents.mapInArrow(run, schema))
        self.arrays = table.where("term is null")
        found = table.where("term is not null").groupBy("term").agg(F.sum("held").alias("n")).toPandas()
        own = found[found["term"] >= 0]
        every = np.zeros(2 * BUCKETS, np.int64)
        every[own["term"]] = own["n"]
        self.live = int(found.loc[found["term"] < 0, "n"].sum())
        self.least = max(5.0, SET_SHARE * self.live)
        frequency, self.often = every[:BUCKETS], every[BUCKETS:] >= self.least  # a phrase as frequent as a set phrase is in such a bucket
        self.idf = np.where(frequency >= 2, np.log((1 + self.live) / (1 + np.maximum(frequency, 1))), 0)

    def grow(self, weight: np.ndarray) -> Tree:
        """Bisecting k-means over the vectors of all documents with weighed terms."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            where = directions()
            for batch in batches:
                own = vectors_of(batch, weight, where)
                own = own[np.abs(own).sum(axis=1) > 0].astype(np.float32)
                offsets = np.arange(len(own) + 1, dtype=np.int32) * DIMENSIONS
                yield pa.RecordBatch.from_pydict({"vector": pa.ListArray.from_arrays(pa.array(offsets), pa.array(own.ravel()))})

        if not (weight > 0).any():  # a weighed term stands in two documents at least
            return Tree(weight, np.zeros((1, DIMENSIONS)))
        rows = written(self.arrays.select(*_BAG).mapInArrow(run, "vector array<float>")).select(array_to_vector("vector").alias("features"))
        fitted = BisectingKMeans(k=LEAVES, maxIter=ROUNDS, seed=7, featuresCol="features").fit(rows)
        return Tree(weight, np.array(fitted.clusterCenters()))

    def leaves(self, tree: Tree) -> Leaves:
        """Terms, keywords and labels of the documents of each leaf."""
        n, size = len(self.domains), len(tree.centres)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            where = directions()
            terms, totals = np.zeros(BUCKETS * size, np.int32), np.zeros((3, size, max(n, 1)), np.int64)
            for batch in batches:
                leaf = tree.leaves_of(batch, where)
                bag, held = unpacked(batch, "bag")
                of = np.repeat(leaf, held)
                own = of >= 0
                np.add.at(terms, bag[own].astype(np.int64) * size + of[own], 1)
                live = np.flatnonzero(leaf >= 0)
                totals[0, :, 0] += np.bincount(leaf[live], minlength=size)
                hit = unpacked(batch, "hits")[0].reshape(batch.num_rows, n) > 0
                np.add.at(totals[1], leaf[live], hit[live])
                for i, given in enumerate(column(batch, "given").to_pylist()):
                    for d in given or ():
                        if d >= 0 and leaf[i] >= 0:
                            totals[2, leaf[i], d] += 1

            def out(kind: int, at: np.ndarray, width: int, v: np.ndarray) -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([pa.array(np.full(len(at), kind), pa.int32()), pa.array(at // width, pa.int32()), pa.array(at % width, pa.int32()), pa.array(v, pa.int64())], ["kind", "b", "at", "v"])

            at = np.flatnonzero(terms)
            yield out(0, at, size, terms[at])
            for kind in range(3):
                at = np.flatnonzero(totals[kind])
                yield out(kind + 1, at, max(n, 1), totals[kind].ravel()[at])

        found = checkpoint(self.arrays.select(*_BAG, "hits", "given").mapInArrow(run, "kind int, b int, at int, v bigint").groupBy("kind", "b", "at").agg(F.sum("v").alias("v")))
        tables = np.zeros((3, size, max(n, 1)))
        for r in found.where("kind > 0").collect():  # leaves by subjects at most
            tables[r["kind"] - 1, r["b"], r["at"]] = r["v"]
        return Leaves(found.where("kind = 0").select("b", "at", "v"), tables[0, :, 0], tables[1, :, :n], tables[2, :, :n])

    def term_shares(self, leaves: Leaves, profiles: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each bucket: its documents, how well it tells leaves apart, its mixture of subjects."""
        size, n = leaves.size, len(self.domains)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                tells, mix = term_mixtures(batch, size, profiles)
                yield pd.DataFrame({"b": batch["b"], "used": [int(v.sum()) for v in batch["v"]], "tells": tells, "mix": list(mix)})

        listed = leaves.terms.groupBy("b").agg(F.collect_list(F.struct("at", "v")).alias("r")).select("b", "r.at", "r.v")  # at most one entry for each leaf
        found = listed.mapInPandas(run, "b int, used bigint, tells double, mix array<double>").toPandas()  # at most BUCKETS rows
        used, tells, mix = np.zeros(BUCKETS), np.zeros(BUCKETS), np.zeros((BUCKETS, n))
        used[found["b"]], tells[found["b"]] = found["used"], found["tells"]
        tells[used < 2] = 0
        if profiles is not None and len(found):
            mix[found["b"]] = np.stack(found["mix"].to_numpy())
        return used, tells, mix

    def profiles(self, leaves: Leaves) -> np.ndarray:
        """Each subject's mixture of leaves, by its keywords among a leaf's documents and the labels there."""
        found = leaves.hits * np.minimum(1, leaves.given.sum(axis=0).max(initial=0) / np.maximum(leaves.hits.sum(axis=0), 1) + 0.1) * 0.2 + leaves.given
        whole = leaves.size / max(leaves.size.sum(), 1)
        return (found + SMOOTH * whole[:, None]) / (found.sum(axis=0) + SMOOTH)

    def leaf_classifier(self) -> Classifier:
        """Terms by the leaf mixtures that explain where they stand."""
        weight = self.idf
        for at in range(TREES):
            leaves = self.leaves(self.grow(weight))
            last = at == TREES - 1
            used, weight, mix = self.term_shares(leaves, self.profiles(leaves) if last else None)
        return Classifier(used, mix)

    def refined(self, classifier: Classifier) -> Classifier:
        """Terms counted in the sentences about each subject, so that passing remarks lend nothing; set phrases are found."""
        n, often, least = len(self.domains), self.often, self.least

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            counts, totals = np.zeros((BUCKETS, n), np.int64), np.zeros((2, n), np.int64)

            def out(kind: int, b: np.ndarray, s: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([pa.array(np.full(len(b), kind), pa.int32()), pa.array(b, pa.int64()), pa.array(s, pa.int32()), pa.array(v, pa.int64())], ["kind", "b", "s", "v"])

            for batch in batches:
                e = Spoken.read(batch)
                found = classifier.sentence_subjects(e)
                mix = classifier.mixtures(e, found)
                best = np.where(mix.sum(axis=1) >= 2, mix.argmax(axis=1), -1)
                about = found[e.of]
                own = about >= 0
                np.add.at(counts.reshape(-1), e.words[own] * n + about[own], 1)
                totals[0] += np.bincount(found[found >= 0], minlength=n)
                totals[1] += np.bincount(best[best >= 0], minlength=n)
                likely = often[e.prints & (BUCKETS - 1)]
                for kind, own in ((1, (e.title == 0) & likely), (3, (e.title > 0) & likely)):
                    phrase, place = np.unique(e.prints[own], return_inverse=True)
                    both, _ = counted(place * e.documents + e.owner[own])
                    held, count = counted(both // e.documents * (n + 1) + best[both % e.documents] + 1)
                    yield out(kind, phrase[held // (n + 1)], held % (n + 1) - 1, count)
            b, s = np.nonzero(counts)
            yield out(0, b, s, counts[b, s])
            for i in range(2):
                yield out(2, np.full(n, i), np.arange(n), totals[i])

        found = checkpoint(self.arrays.select(*_SPOKEN).mapInArrow(run, "kind int, b bigint, s int, v bigint").groupBy("kind", "b", "s").agg(F.sum("v").alias("v")))
        words = found.where("kind = 0").toPandas()  # at most BUCKETS by subjects
        counts, totals = np.zeros((BUCKETS, n)), np.zeros((2, n))
        counts[words["b"], words["s"]] = words["v"]
        whole = found.where("kind = 2").toPandas()
        totals[whole["b"], whole["s"]] = whole["v"]
        rates = F.array(*[F.sum(F.when(F.col("s") == d, F.col("v") / float(max(totals[1, d], 1e-9))).otherwise(0.0)) for d in range(n)])
        known = F.sum(F.when(F.col("s") >= 0, F.col("v")).otherwise(0)).alias("known")
        used = found.where("kind in (1, 3)").groupBy("kind", "b").agg(F.sum("v").alias("n"), known, rates.alias("r")).where(F.col("n") >= least)
        top = F.array_max("r") / F.greatest(F.aggregate("r", F.lit(0.0), lambda a, x: a + x), F.lit(1e-12))
        formula = (F.col("kind") == 1) & (F.col("known") < 0.25 * F.col("n"))  # said mostly where nothing else is; a title's use there says nothing
        # at most (sentences of a document) / SET_SHARE phrases
        flat = used.where(formula | (F.col("known") >= least) & (top < SET_FLAT)).select("b").toPandas()
        return Classifier.counted(counts, totals[0], frozenset(int(x) for x in flat["b"]))

    def assign(self, classifier: Classifier, least_share: float, short: int, most: int | None) -> DataFrame:
        """``key``, ``subject`` (number), ``share`` (null when a title names it), ``by``."""
        key, titles = self.key, len(self.titles)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                e = Spoken.read(batch)
                found = classifier.sentence_subjects(e)
                mix = classifier.mixtures(e, found)
                own = (e.title == 0) & ~np.isin(e.prints, classifier.set_phrases)
                lengths = np.bincount(e.owner[own], minlength=e.documents)
                dealt = dealt_with(mix, lengths, least_share, short, most)
                rows, cols = np.nonzero(dealt)
                share = mix[rows, cols] / mix.sum(axis=1)[rows]
                named = np.full(e.documents, -1)
                for kind in range(titles, 0, -1):
                    own = np.flatnonzero((e.title == kind) & (found >= 0))
                    named[e.owner[own]] = found[own]
                bare = np.flatnonzero(~dealt.any(axis=1) & (named >= 0))
                every = np.concatenate((rows, bare))
                shares = pa.array(np.concatenate((share, np.zeros(len(bare)))), mask=np.arange(len(every)) >= len(rows))
                subject = pa.array(np.concatenate((cols, named[bare])), pa.int32())
                yield pa.RecordBatch.from_arrays([column(batch, key).take(pa.array(every, pa.int64())), subject, shares, pa.array(["content"] * len(rows) + ["title"] * len(bare), pa.string())], [key, "subject", "share", "by"])

        return self.arrays.select(key, *_SPOKEN).mapInArrow(run, f"`{key}` {self.kind}, subject int, share double, by string")

    def run(self, least_share: float = LEAST_SHARE, short: int = SHORT, most: int | None = MOST) -> DataFrame:
        self.encode()
        return self.assign(self.refined(self.leaf_classifier()), least_share, short, most)


def once(speeches: DataFrame, key: str, loaded: str) -> DataFrame:
    """Rows of ``speeches`` as delivered last; only the few keys that came again are joined, not the texts shuffled."""
    again = speeches.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n"), F.max(loaded).alias("_last")).where("_n > 1").drop("_n")
    again = broadcast_if_small(checkpoint(again))
    return speeches.join(again, key, "left").where(F.col("_last").isNull() | F.col(loaded).eqNullSafe(F.col("_last"))).drop("_last")


def subjects(speeches: DataFrame, domains: DataFrame, topic_labels: DataFrame, least_share: float = LEAST_SHARE, short: int = SHORT, most: int | None = MOST) -> DataFrame:
    """``sid``, ``domain_id``, ``share``, ``by``: the subjects that each speech deals with.

    1. Speeches become normalised TF-IDF vectors (words hashed, projected by random signs), and
       bisecting k-means makes a tree of all of them. (Further trees may be grown over the terms
       weighed by how well they tell the leaves before apart.)
    2. Each subject has a mixture of leaves, by the domains' keywords and the labels among
       their speeches. A term's spread over the leaves is explained as a mixture of those,
       which gives the terms that discriminate, and so label, each subject's leaves.
    3. Terms give sentences their subjects; sentences used all over are set phrases and
       speak for none. Terms are counted once more in the sentences about each subject.
    4. The sentences of a speech give its mixture. Content deals with a subject that has two sentences
       and ``least_share`` of them (one, in a speech of ``short`` sentences or fewer, set phrases not counted); a
       lone sentence in a longer one is a passing remark. At most ``most`` subjects stand, the ones with most
       sentences (None: all). Where content deals with none, the subject of ``dossier_title``, else of
       ``debate_title``, is taken.

    All labels are used; one that is null says that the speech has no subject.
    Speeches delivered again count once; those without ``sid`` are left out; null or
    empty contents and titles name nothing. ``domains`` is a fixed list.
    """
    listed = domains.where("domain_id is not null").orderBy("domain_id").dropDuplicates(["domain_id"]).collect()
    names = sorted(r["domain_id"] for r in listed)
    place = {d: i for i, d in enumerate(names)}
    words = [(place[r["domain_id"]], " " + " ".join(_WORD.findall(k.lower())) + " ") for r in listed for k in (r["keywords"] or []) if k and _WORD.search(k)]
    spark = speeches.sparkSession
    if not names:
        return spark.createDataFrame([], "sid bigint, domain_id string, share double, by string")
    own = once(speeches.select("sid", "content", "dossier_title", "debate_title", "loaded_at"), "sid", "loaded_at").where("sid is not null")
    numbered = F.element_at(F.create_map(*[x for d, i in place.items() for x in (F.lit(d), F.lit(i))]), F.col("domain_id"))
    labels = topic_labels.where("sid is not null").select("sid", F.coalesce(numbered, F.lit(-1)).alias("subject")).distinct()
    found = SubjectModel(own, "sid", "content", ["dossier_title", "debate_title"], names, words, labels).run(least_share, short, most)
    named = F.element_at(F.array(*[F.lit(d) for d in names]), F.col("subject") + 1)
    return found.select("sid", named.alias("domain_id"), "share", "by").dropDuplicates(["sid", "domain_id"])
