"""A mixture of sources in target shares."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plenaria.llm.sizes import TOKENIZER, token_counts
from plenaria.operators.scan import carry_scan, range_sorted
from plenaria.session import checkpoint

_ONE = 1 << 32


def expected_copies(sources: dict[str, tuple[float, int, int]], total: float | None = None) -> dict[str, float]:
    """Copies that each document of a source should have, from (share, cap, tokens) by source.

    Without ``total``: the largest mixture in which every source that has tokens reaches its share.
    With it: sources that would exceed their cap stay at it, and the others fill the total in
    the ratio of their shares. Shares count among the sources that have tokens.
    """
    live = {s: v for s, v in sources.items() if v[0] > 0 and v[1] > 0 and v[2] > 0}
    copies = dict.fromkeys(sources, 0.0)
    if not live:
        return copies
    if total is None:
        unit = min(cap * tokens / share for share, cap, tokens in live.values())
        return copies | {s: min(cap, share * unit / tokens) for s, (share, cap, tokens) in live.items()}
    left, open_ = float(total), dict(live)
    while open_:
        weight = sum(share for share, _, _ in open_.values())
        over = [s for s, (share, cap, tokens) in open_.items() if left * share / weight > cap * tokens]
        if not over:
            return copies | {s: left * share / weight / tokens for s, (share, _, tokens) in open_.items()} | {s: copies[s] for s in live if s not in open_}
        for s in over:
            _, cap, tokens = open_.pop(s)
            copies[s] = float(cap)
            left -= cap * tokens
    return copies


def _offset(source: str, seed: int) -> int:
    return int.from_bytes(hashlib.blake2b(f"{seed}:{source}".encode(), digest_size=4).digest(), "big")


def systematic(items: DataFrame, key: str, source: str, size: str, copies: dict[str, float], seed: int = 17) -> DataFrame:
    """``key``, ``source``, ``size``, ``copies`` of the items that are drawn at least once.

    Within a source, in the order of size and key, each item's expected copies are
    summed; with one random offset, an item is drawn once for each whole number
    that the sum crosses. So an item has the rounded-down or rounded-up number of
    expected copies, and items of every size are drawn evenly. The sum follows from the item's
    place, found by a range sort and carried counts, so a source of any size is spread.
    """
    names = sorted(copies)
    rate = {s: int(copies[s] * _ONE) for s in names}
    start = {s: _offset(s, seed) for s in names}
    ordered = range_sorted(items.select(source, size, key), [source, size, key])

    def counted(batches: Iterator[pd.DataFrame], state: tuple[str, int] | None) -> Iterator[tuple[pd.DataFrame, np.ndarray, tuple[str, int]]]:
        for batch in batches:
            place = batch.groupby(source, sort=False).cumcount().to_numpy(np.uint64)
            if state is not None:
                place += np.where(batch[source] == state[0], np.uint64(state[1]), np.uint64(0))
            state = (batch[source].iloc[-1], int(place[-1]) + 1)
            yield batch, place, state

    def summarise(batches: Iterator[pd.DataFrame]) -> dict | None:
        head, state = None, None
        for batch, _, state in counted(batches, None):
            head = batch[source].iloc[0] if head is None else head
        return None if state is None else {"_head": head, "_tail": state[0], "_count": state[1]}

    def combine(state: tuple[str, int] | None, found: dict) -> tuple[str, int]:
        more = state[1] if state is not None and found["_head"] == found["_tail"] == state[0] else 0
        return found["_tail"], found["_count"] + more

    def rescan(batches: Iterator[pd.DataFrame], state: tuple[str, int] | None) -> Iterator[pd.DataFrame]:
        for batch, place, _ in counted(batches, state):
            rates = batch[source].map(rate).to_numpy(np.uint64)
            phase = (batch[source].map(start).to_numpy(np.uint64) + place * rates) % np.uint64(_ONE)  # whole numbers drop out
            drawn = (phase + rates) // np.uint64(_ONE)
            out = batch[[key, source, size]].assign(copies=drawn.astype(np.int64))
            yield out[out["copies"] > 0]

    types = ", ".join(f"`{c}` {items.schema[c].dataType.simpleString()}" for c in (key, source, size))
    return carry_scan(ordered, summarise, "_head string, _tail string, _count bigint", combine, rescan, f"{types}, copies bigint")


def _sized(documents: DataFrame, targets: DataFrame, path: str) -> tuple[DataFrame, dict[str, tuple[float, int, int]]]:
    """Documents of listed sources with their tokens, and (share, cap, tokens) of each source.

    ``targets`` names sources, a table that doesn't grow with the documents.
    """
    listed = {r["source"]: (r["target_share"] or 0.0, r["max_repeats"] or 0) for r in targets.where("source is not null").groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats")).collect()}
    counted = token_counts(documents, keep=["source"], path=path)
    own = counted.where(F.col("doc_id").isNotNull() & F.col("source").isin(list(listed)) & (F.col("tokens") > 0))
    once = checkpoint(own.groupBy("doc_id").agg(F.max(F.struct("tokens", "source")).alias("_r")).select("doc_id", "_r.source", "_r.tokens"))
    held = {r["source"]: r["tokens"] for r in once.groupBy("source").agg(F.sum("tokens").alias("tokens")).collect()}
    return once, {s: (share, cap, held.get(s, 0)) for s, (share, cap) in listed.items()}


def mixture(documents: DataFrame, targets: DataFrame, total: int | None = None, seed: int = 17, path: str = TOKENIZER) -> DataFrame:
    """``doc_id``, ``copy_no``, ``source``, ``tokens``: one row for each copy in the mixture.

    ``total``: tokens wanted; None takes the largest mixture in which every listed
    source that has documents reaches its share. Documents without id, without
    text, or of a source that isn't listed (or null) have no share and are left out; rows of
    one ``doc_id`` count once.
    """
    sized, sources = _sized(documents, targets, path)
    drawn = systematic(sized, "doc_id", "source", "tokens", expected_copies(sources, total), seed)
    return drawn.select("doc_id", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy_no"), "source", "tokens")


def shares(documents: DataFrame, targets: DataFrame, total: int | None = None, seed: int = 17, path: str = TOKENIZER) -> DataFrame:
    """For each listed source its target share and the share it reached, with tokens, documents and copies."""
    sized, sources = _sized(documents, targets, path)
    drawn = systematic(sized, "doc_id", "source", "tokens", expected_copies(sources, total), seed)
    taken = drawn.groupBy("source").agg(
        F.sum(F.col("tokens") * F.col("copies")).alias("mixture_tokens"), F.count(F.lit(1)).alias("documents"),
        F.sum("copies").alias("copies"), F.max("copies").alias("most_repeats"),
    )
    got = {r["source"]: r for r in taken.collect()}  # one row for each listed source
    whole = sum(r["mixture_tokens"] for r in got.values())
    rows = []
    for s, (share, cap, tokens) in sorted(sources.items()):
        own = [got[s][c] for c in ("mixture_tokens", "documents", "copies", "most_repeats")] if s in got else [0] * 4
        rows.append((s, float(share), int(cap), int(tokens), *own, own[0] / whole if whole else 0.0))
    names = "source string, target_share double, max_repeats int, available_tokens bigint, mixture_tokens bigint, documents bigint, copies bigint, most_repeats bigint, actual_share double"
    return documents.sparkSession.createDataFrame(rows, names)
