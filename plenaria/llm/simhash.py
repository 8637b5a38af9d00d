"""Near-duplicate texts by partitioned SimHash tables."""

from __future__ import annotations

import math
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plenaria.llm.components import connected_components
from plenaria.session import broadcast_if_small, checkpoint, written

#: Words of a shingle, and the Jaccard similarity of shingle sets from which texts are near-duplicates.
SHINGLE, SIMILARITY = 5, 0.8
#: Fingerprints of 64 bits for each text.
PRINTS = 4
#: Chance that a bit of two texts at the least similarity differs: the angle between their sets, over pi.
APART = math.acos(2 * SIMILARITY / (1 + SIMILARITY)) / math.pi
#: Share of pairs at the least similarity that some table must bring together.
RECALL = 0.97
#: Bits in which they may differ: the mean and three and a half standard deviations.
HAMMING = math.ceil(64 * PRINTS * APART + 3.5 * math.sqrt(64 * PRINTS * APART * (1 - APART)))
#: Least bits of a table's key.
LEAST_BITS = 16

_WORD = re.compile(r"\w+")
_MASK = np.uint64(0x9E3779B97F4A7C15)
_HASH_BITS = np.uint64(16)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _folded(own: np.ndarray, size: int) -> np.ndarray:
    """A hash of every ``size`` words in a row."""
    n = len(own) - size + 1
    mixed = np.zeros(n, dtype=np.uint64)
    for k in range(size):
        mixed = _mixed(mixed * _MASK + own[k : k + n])
    return mixed


def shingle_sets(words: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of texts whose word hashes stand one after the other: (text, 48-bit hash).

    A text of fewer words than a shingle is one shingle, one without words has none. At most 65,536 texts.
    """
    ends = np.cumsum(lengths)
    starts, owner = ends - lengths, np.repeat(np.arange(len(lengths)), lengths)
    keys = []
    if len(words) >= SHINGLE:
        at = np.flatnonzero(np.arange(len(words)) + SHINGLE <= ends[owner])
        keys.append((owner[at].astype(np.uint64) << np.uint64(48)) | (_folded(words, SHINGLE)[at] >> _HASH_BITS))
    for i in np.flatnonzero((lengths > 0) & (lengths < SHINGLE)):
        keys.append((np.uint64(i) << np.uint64(48)) | (_folded(words[starts[i] : ends[i]], int(lengths[i])) >> _HASH_BITS))
    found = np.sort(np.concatenate(keys)) if keys else np.zeros(0, np.uint64)
    found = found[np.append(True, found[1:] != found[:-1])] if len(found) else found
    return (found >> np.uint64(48)).astype(np.int64), found & np.uint64((1 << 48) - 1)


class WordHashes(dict):
    """64-bit hashes of words; it fills itself as words are met."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h

    def of(self, words: list[str]) -> bytes:
        return array("Q", map(self.__getitem__, words)).tobytes()


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def shingles(text: str, seen: WordHashes | None = None) -> np.ndarray:
    """Distinct hashes of the five-word shingles of a whole text."""
    own = np.frombuffer((WordHashes() if seen is None else seen).of(words_of(text)), np.uint64)
    return shingle_sets(own, np.array([len(own)]))[1]


def fingerprints(owner: np.ndarray, hashes: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray]:
    """SimHashes (``texts`` by PRINTS signed numbers) and sizes of sets from :func:`shingle_sets`."""
    sizes = np.bincount(owner, minlength=texts)
    ends = np.cumsum(sizes)
    mixed = np.stack([_mixed(hashes + np.array([p + 1], np.uint64) * _MASK) for p in range(PRINTS)], axis=1).astype(">u8").view(np.uint8).reshape(len(hashes), 8 * PRINTS)
    ones = np.zeros((texts, 64 * PRINTS), np.int64)
    for i in np.flatnonzero(sizes):
        for at in range(ends[i] - sizes[i], ends[i], 255):  # what one byte can count
            ones[i] += np.unpackbits(mixed[at : min(at + 255, ends[i])], axis=1).sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * ones > sizes[:, None], axis=1).view(">i8").astype(np.int64), sizes


def text_fingerprints(texts: DataFrame, key: str, text: str) -> DataFrame:
    """``key``, ``prints`` (array of bigint), ``n`` (distinct shingles) of every text that has words."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = WordHashes()
        for batch in batches:
            hashes = [seen.of(words_of(t)) for t in batch[text]]
            lengths = np.array([len(h) // 8 for h in hashes], dtype=np.int64)
            prints, n = fingerprints(*shingle_sets(np.frombuffer(b"".join(hashes), np.uint64), lengths), len(lengths))
            out = pd.DataFrame({key: batch[key], "prints": list(prints), "n": n})
            yield out[out["n"] > 0]

    kind = texts.schema[key].dataType.simpleString()
    return texts.select(key, text).where(F.col(text).isNotNull()).mapInPandas(run, f"`{key}` {kind}, prints array<bigint>, n bigint")


def tables_for(count: int) -> list[np.ndarray]:
    """The bits that key each table.

    A key has so many bits that texts unlike each other meet about once a table whatever their number, and there are so
    many tables that a pair at the least similarity shares a key with a chance of ``RECALL``.
    """
    bits = max(LEAST_BITS, math.ceil(math.log2(max(count, 2))))
    number = math.ceil(math.log(1 - RECALL) / math.log(1 - (1 - APART) ** bits))
    rng = np.random.default_rng(23)
    return [rng.choice(64 * PRINTS, bits, replace=False) for _ in range(number)]


def _keyed(heads: DataFrame, key: str, tables: list[np.ndarray]) -> DataFrame:
    """``key``, ``_seed``, ``_key``: a row for each text and table."""
    powers = [np.left_shift(np.int64(1), np.arange(len(bits), dtype=np.int64)) for bits in tables]
    shift = np.int64(max(len(bits) for bits in tables))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2_000):
                part = batch.slice(at, 2_000)
                prints = part.column(2).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, PRINTS)
                bits = np.unpackbits(np.ascontiguousarray(prints.astype(">i8")).view(np.uint8).reshape(part.num_rows, 8 * PRINTS), axis=1)
                keys = np.stack([(np.int64(t) << shift) | (bits[:, own].astype(np.int64) @ powers[t]) for t, own in enumerate(tables)], axis=1)
                rows = pa.array(np.repeat(np.arange(part.num_rows), len(tables)))
                yield pa.RecordBatch.from_arrays([part.column(0).take(rows), part.column(1).take(rows), pa.array(keys.ravel())], [key, "_seed", "_key"])

    kind = heads.schema[key].dataType.simpleString()
    return heads.select(key, "_seed", "prints").mapInArrow(run, f"`{key}` {kind}, _seed boolean, _key bigint")


def near_duplicates(texts: DataFrame, key: str, text: str, seeds: DataFrame | None = None, heads: DataFrame | None = None) -> DataFrame:
    """``a``, ``b``, ``similarity``: links of near-duplicate texts, ``a`` < ``b``.

    ``texts`` should hold each distinct text once; ``heads`` may give their fingerprints (see
    :func:`text_fingerprints`). With ``seeds`` (a table of keys) links are found from these texts on: those
    of seeds, then those of the texts that they reach, and so on, so every component with a
    seed is whole and no other text is compared. Without, all texts are seeds.

    Texts that agree in a table's key form a bucket. A bucket's smallest seed leads it, and each member is compared
    with it, so that many copies give one link each. Members that aren't similar
    to their leader are then compared with all of the bucket. Each pair that meets is verified: by size
    and Hamming distance, then by the Jaccard similarity of the whole texts' shingles. So
    the links connect all that the tables bring together, without all pairs of a group of copies.

    The tables bring a pair at the least similarity together with a chance of ``RECALL``. Texts without words
    (or null) are linked to none; an empty table gives an empty result.
    """
    heads = written(text_fingerprints(texts, key, text)) if heads is None else heads
    tables = tables_for(heads.count())
    if seeds is None:
        return _linked(texts, key, text, heads.withColumn("_seed", F.lit(True)), tables)
    frontier = checkpoint(heads.join(broadcast_if_small(seeds.select(key).distinct()), key, "left_semi").select(key))
    reached, links = frontier, None
    while True:
        marked = heads.join(broadcast_if_small(frontier.withColumn("_seed", F.lit(True))), key, "left").withColumn("_seed", F.coalesce("_seed", F.lit(False)))
        found = _linked(texts, key, text, marked, tables)
        links = found if links is None else links.unionByName(found)
        ends = found.select(F.explode(F.array("a", "b")).alias(key)).distinct()
        frontier = checkpoint(ends.join(reached, key, "left_anti"))
        if frontier.isEmpty():
            return links.distinct()
        reached = reached.unionByName(frontier)


def _linked(texts: DataFrame, key: str, text: str, heads: DataFrame, tables: list[np.ndarray]) -> DataFrame:
    """Verified links of the texts marked ``_seed``."""
    seeds = _keyed(heads.where("_seed"), key, tables)
    led = checkpoint(seeds.groupBy("_key").agg(F.min(key).alias("_leader")))
    members = _keyed(heads, key, tables).join(broadcast_if_small(led), "_key").where(F.col(key) != F.col("_leader"))
    members = checkpoint(members)
    a, b = F.least(key, "_leader").alias("a"), F.greatest(key, "_leader").alias("b")
    first = checkpoint(_verified(texts, key, text, heads, members.select(a, b).distinct()))
    rest = members.withColumn("a", a).withColumn("b", b).join(broadcast_if_small(first.select("a", "b")), ["a", "b"], "left_anti").select("_key", F.col(key).alias("_u"), F.col("_seed").alias("_su"))
    other = members.select("_key", F.col(key).alias("_m"), F.col("_seed").alias("_sm"))
    met = rest.join(other, "_key").where((F.col("_u") != F.col("_m")) & (F.col("_su") | F.col("_sm"))).select(F.least("_u", "_m").alias("a"), F.greatest("_u", "_m").alias("b")).distinct()
    return first.unionByName(checkpoint(_verified(texts, key, text, heads, met))).distinct()


def _verified(texts: DataFrame, key: str, text: str, heads: DataFrame, pairs: DataFrame) -> DataFrame:
    """Pairs whose fingerprints and then whole texts are similar enough."""
    own = heads.select(key, "prints", "n")
    met = pairs.join(own.toDF("a", "_pa", "_na"), "a").join(own.toDF("b", "_pb", "_nb"), "b")
    apart = sum((F.bit_count(F.col("_pa")[i].bitwiseXOR(F.col("_pb")[i])) for i in range(1, PRINTS)), F.bit_count(F.col("_pa")[0].bitwiseXOR(F.col("_pb")[0])))
    close = checkpoint(met.where((apart <= HAMMING) & (F.least("_na", "_nb") >= SIMILARITY * F.greatest("_na", "_nb"))).select("a", "b"))
    ends = close.select(F.explode(F.array("a", "b")).alias(key)).distinct()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = WordHashes()
        for batch in batches:
            yield pd.DataFrame({key: batch[key], "_s": [shingles(t, seen).view(np.int64) for t in batch[text]]})

    kind = texts.schema[key].dataType.simpleString()
    read = checkpoint(texts.select(key, text).join(broadcast_if_small(ends), key, "left_semi").mapInPandas(run, f"`{key}` {kind}, _s array<bigint>"))
    both = F.size(F.array_intersect("_sa", "_sb"))
    similarity = F.try_divide(both, F.size("_sa") + F.size("_sb") - both)
    joined = close.join(read.toDF("a", "_sa"), "a").join(read.toDF("b", "_sb"), "b")
    return joined.select("a", "b", similarity.alias("similarity")).where(F.col("similarity") >= SIMILARITY)


def classes(texts: DataFrame, key: str, text: str) -> DataFrame:
    """``node``, ``component`` of the texts that have a near-duplicate."""
    return connected_components(near_duplicates(texts, key, text))
