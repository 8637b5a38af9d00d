"""TF-IDF rows and topics by non-negative matrix factorisation."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plenaria.session import checkpoint


def tfidf_rows(df: DataFrame, key: str, tokens: str, least_df: int = 3, most_share: float = 0.5) -> DataFrame:
    """``key``, ``term``, ``weight``: sublinear TF-IDF of each document, of length 1.

    Terms in fewer than ``least_df`` documents or in more than ``most_share`` of them have no weight.
    """
    held = df.where(F.size(tokens) > 0)
    n = held.count()
    tf = held.select(key, F.explode(tokens).alias("term")).groupBy(key, "term").agg(F.count(F.lit(1)).alias("_tf"))
    used = tf.groupBy("term").agg(F.count(F.lit(1)).alias("_df")).where((F.col("_df") >= least_df) & (F.col("_df") <= most_share * n))
    raw = tf.join(used, "term").select(key, "term", ((1 + F.ln("_tf")) * (F.ln(F.lit(1 + n) / (1 + F.col("_df"))) + 1)).alias("_w"))
    norms = raw.groupBy(key).agg(F.sqrt(F.sum(F.col("_w") * F.col("_w"))).alias("_n"))
    return raw.join(norms, key).select(key, "term", (F.col("_w") / F.col("_n")).alias("weight"))


def grams(tokens: str) -> Column:
    """Single words and pairs of neighbours."""
    n = F.greatest(F.size(tokens) - 1, F.lit(0))
    return F.concat(F.col(tokens), F.zip_with(F.slice(tokens, 1, n), F.slice(tokens, 2, n), lambda a, b: F.concat_ws(" ", a, b)))


def tfidf_arrays(df: DataFrame, key: str, tokens: str, least_df: int = 30, most_share: float = 0.55, features: int = 8000) -> tuple[DataFrame, list[str]]:
    """``key``, ``t``, ``w``: terms (by place) and TF-IDF of length 1 of every document, and the terms.

    Terms are words and pairs of words in ``least_df`` documents at least and in ``most_share`` of those with words at most; the
    ``features`` most used of them count. A document without any has empty arrays.
    """
    held = df.where(F.size(tokens) > 0)
    n = held.count()
    tf = held.select(key, F.explode(grams(tokens)).alias("term")).groupBy(key, "term").agg(F.count(F.lit(1)).alias("_tf"))
    used = tf.groupBy("term").agg(F.count(F.lit(1)).alias("_df"), F.sum("_tf").alias("_uses")).where((F.col("_df") >= least_df) & (F.col("_df") <= most_share * n))
    best = used.orderBy(F.desc("_uses"), "term").limit(features).collect()
    place = {r["term"]: i for i, r in enumerate(best)}
    idf = np.log((1 + n) / (1 + np.array([r["_df"] for r in best], float))) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms, weights = [], []
            for words in batch.column(1).to_pylist():
                words = words or []
                own = Counter(words)
                own.update(map(" ".join, zip(words, words[1:])))
                found = sorted((place[g], c) for g, c in own.items() if g in place)
                t = np.array([i for i, _ in found], np.int32)
                w = np.array([c for _, c in found], float) * idf[t]
                terms.append(t)
                weights.append(w / max(np.linalg.norm(w), 1e-300))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(terms, pa.list_(pa.int32())), pa.array(weights, pa.list_(pa.float64()))], [key, "t", "w"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, tokens).mapInArrow(run, f"`{key}` {kind}, t array<int>, w array<double>"), [r["term"] for r in best]


def nmf(rows: DataFrame, key: str, topics: int = 15, features: int = 8000, rounds: int = 400, seed: int = 0) -> tuple[DataFrame, list[list[tuple[str, float]]]]:
    """Topic weights of each document (``key``, ``topic``, ``weight``) and each topic's terms, best first.

    ``rows`` are those of :func:`tfidf_rows`; the ``features`` terms with the most weight count.
    """
    best = [r["term"] for r in rows.groupBy("term").agg(F.sum("weight").alias("_w")).orderBy(F.desc("_w"), "term").limit(features).collect()]
    spark = rows.sparkSession
    place = spark.createDataFrame(list(zip(best, range(len(best)))), "term string, _t int")
    numbered = rows.join(F.broadcast(place), "term", "left")  # at most ``features`` rows
    docs = numbered.groupBy(key).agg(F.array_sort(F.collect_list(F.when(F.col("_t").isNotNull(), F.struct("_t", "weight")))).alias("_d")).select(key, F.col("_d._t").alias("t"), F.col("_d.weight").alias("w"))
    return factorised(docs, key, best, topics, rounds, seed)


def _times(t: np.ndarray, w: np.ndarray, sizes: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sparse rows (terms, weights, their number in each row; none empty) by a matrix of terms."""
    out, ends = np.empty((len(sizes), right.shape[1])), np.cumsum(sizes)
    for a in range(0, len(sizes), 2048):  # so many rows at a time, for memory
        own = slice(ends[a] - sizes[a], ends[min(a + 2048, len(sizes)) - 1])
        out[a : a + 2048] = np.add.reduceat(right[t[own]] * w[own, None], ends[a : a + 2048] - sizes[a : a + 2048] - own.start, axis=0)
    return out


def _nonnegative(gram: np.ndarray, target: np.ndarray, x: np.ndarray, sweeps: int = 200) -> np.ndarray:
    """The x >= 0 that minimises x gram x' / 2 - x target', by coordinate descent over the columns of all rows."""
    x = x.copy()
    for _ in range(sweeps):
        most = 0.0
        for k in np.flatnonzero(np.diag(gram) > 1e-15):
            own = np.maximum(x[:, k] + (target[:, k] - x @ gram[:, k]) / gram[k, k], 0)
            most = max(most, float(np.abs(own - x[:, k]).max(initial=0)))
            x[:, k] = own
        if most <= 1e-6 * max(float(x.max(initial=0)), 1e-12):
            break
    return x


def factorised(docs: DataFrame, key: str, terms: list[str], topics: int, rounds: int, seed: int = 0, tolerance: float = 1e-4) -> tuple[DataFrame, list[list[tuple[str, float]]]]:
    """Topic weights of each document (``key``, ``topic``, ``weight``) and each topic's terms, best first.

    ``docs``: ``key``, ``t``, ``w`` as of :func:`tfidf_arrays`. A document without terms has one row, topic and weight null.
    Starts from the singular vectors (NNDSVDa) and ends when the projected gradient is ``tolerance`` of that at the start,
    or after ``rounds``. Only the factor of topics by terms, bounded by its parameters, is on the
    driver: a round sends it to the documents' partitions, which fit their rows exactly and return sums for its update.
    """
    spark, m = docs.sparkSession, len(terms)
    kind = docs.schema[key].dataType.simpleString()
    docs = checkpoint(docs.select(key, "t", "w"))
    if not terms:
        return docs.select(key, F.lit(None).cast("int").alias("topic"), F.lit(None).cast("double").alias("weight")), []

    def read(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        column = batch.column(1)
        sizes = np.diff(column.offsets.to_numpy())
        return column.flatten().to_numpy(zero_copy_only=False), batch.column(2).flatten().to_numpy(zero_copy_only=False), sizes[sizes > 0], sizes > 0

    def back(t: np.ndarray, w: np.ndarray, sizes: np.ndarray, left: np.ndarray) -> np.ndarray:
        owner = np.repeat(np.arange(len(sizes)), sizes)
        return np.stack([np.bincount(t, w * c[owner], m) for c in left.T])

    def summed(each: Callable[..., list[np.ndarray]], shapes: list[tuple[int, ...]]) -> list[np.ndarray]:
        """Sums over all documents of what ``each`` gives for a batch: one row for each partition."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = [np.zeros(s) for s in shapes]
            for batch in batches:
                t, w, sizes, _ = read(batch)
                if len(sizes):
                    for x, y in zip(total, each(t, w, sizes)):
                        x += y
            yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([x.ravel() for x in total])], pa.list_(pa.float64()))], ["v"])

        whole = np.zeros(sum(int(np.prod(s)) for s in shapes))
        for part in docs.select(key, "t", "w").mapInArrow(run, "v array<double>").toArrow().column(0).chunks:
            for row in part:
                whole += row.values.to_numpy()
        cuts = np.cumsum([int(np.prod(s)) for s in shapes])[:-1]
        return [x.reshape(s) for x, s in zip(np.split(whole, cuts), shapes)]

    # singular vectors by subspace iteration
    width = min(m, topics + 10)
    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(m, width)))[0]
    for _ in range(8):
        (z, count, weight) = summed(lambda t, w, sizes, q=q: [back(t, w, sizes, _times(t, w, sizes, q)), np.array([len(sizes)]), np.array([w.sum()])], [(width, m), (1,), (1,)])
        values, turn = np.linalg.eigh((q.T @ z.T + z @ q) / 2)
        right, scale = (q @ turn)[:, ::-1], np.sqrt(np.maximum(values[::-1], 0))
        q = np.linalg.qr(z.T)[0]
    k = min(topics, width)
    right, scale = right[:, :k], scale[:k]
    plus, minus = summed(lambda t, w, sizes: [(np.maximum(u := _times(t, w, sizes, right), 0) ** 2).sum(axis=0), (np.minimum(u, 0) ** 2).sum(axis=0)], [(k,), (k,)])
    h = np.zeros((topics, m))
    for i in range(k):
        if scale[i] < 1e-9:
            continue
        up, down = np.maximum(right[:, i], 0), np.maximum(-right[:, i], 0)
        sides = [(np.sqrt(a) / scale[i] * np.linalg.norm(b), b) for a, b in ((plus[i], up), (minus[i], down))]
        size, own = (1.0, np.abs(right[:, i])) if i == 0 else max(sides, key=lambda x: x[0])
        h[i] = np.sqrt(scale[i] * size) * own / max(np.linalg.norm(own), 1e-12)
    h[h < 1e-6] = float(weight[0]) / max(float(count[0]) * m, 1)

    def fitted(t: np.ndarray, w: np.ndarray, sizes: np.ndarray, h: np.ndarray) -> np.ndarray:
        target = _times(t, w, sizes, np.ascontiguousarray(h.T))
        return _nonnegative(h @ h.T, target, np.zeros_like(target))

    def sums(t: np.ndarray, w: np.ndarray, sizes: np.ndarray, h: np.ndarray) -> list[np.ndarray]:
        left = fitted(t, w, sizes, h)
        return [left.T @ left, back(t, w, sizes, left)]

    start = None
    for _ in range(rounds):
        ww, wv = summed(lambda t, w, sizes, h=h: sums(t, w, sizes, h), [(topics, topics), (topics, m)])
        slope = ww @ h - wv
        violation = float(np.abs(np.where(h > 0, slope, np.minimum(slope, 0))).sum())
        start = violation if start is None else start
        if violation <= tolerance * start:
            break
        h = _nonnegative(ww, wv.T, h.T, 50).T

    final = h

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t, w, sizes, live = read(batch)
            at, bare = np.flatnonzero(live), np.flatnonzero(~live)
            weights = fitted(t, w, sizes, final).ravel() if len(at) else np.zeros(0)
            none = np.arange(len(weights) + len(bare)) >= len(weights)
            topic = np.concatenate((np.tile(np.arange(topics, dtype=np.int32), len(at)), np.zeros(len(bare), np.int32)))
            keys = batch.column(0).take(pa.array(np.concatenate((np.repeat(at, topics), bare))))
            yield pa.RecordBatch.from_arrays([keys, pa.array(topic, mask=none), pa.array(np.concatenate((weights, np.zeros(len(bare)))), mask=none)], [key, "topic", "weight"])

    listed = [[(terms[i], float(h[k, i])) for i in np.argsort(-h[k])[:20]] for k in range(topics)]
    return docs.mapInArrow(placed, f"`{key}` {kind}, topic int, weight double"), listed
