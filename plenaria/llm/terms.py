"""Frequency of every term, and the best terms of every group."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plenaria.operators.scan import numbered
from plenaria.operators.skew import all_salts, hot_keys, salt
from plenaria.operators.topk import top_k
from plenaria.session import broadcast_if_small, checkpoint, shuffle_partitions


def normal_term(text: str | None) -> str | None:
    """NFC, lower case, straight apostrophes, single spaces; null when nothing is left."""
    if text is None:
        return None
    lowered = unicodedata.normalize("NFC", unicodedata.normalize("NFC", text).lower())
    return " ".join(lowered.replace("’", "'").split()) or None


def normal_terms(column: str) -> Column:
    """:func:`normal_term` over a column, in Arrow batches."""

    def run(texts: pd.Series) -> pd.Series:
        return texts.map(normal_term, na_action="ignore")

    return F.pandas_udf(run, "string")(column)


def vocabulary(ngrams: DataFrame) -> DataFrame:
    """``gid``, ``term``: the normalised spelling of every known ``gid``.

    Blank or null texts name no term and are left out; a repeated ``gid`` counts once
    (the smallest term, should its rows disagree).
    """
    named = ngrams.select("gid", normal_terms("text").alias("term")).where("gid is not null and term is not null")
    return named.groupBy("gid").agg(F.min("term").alias("term"))


def with_terms(uses: DataFrame, words: DataFrame, rows: int, keep: list[str]) -> DataFrame:
    """Rows of ``uses`` joined with ``words`` on ``gid``, rows of hot ``gid`` spread by ``sid``.

    The result is hash-partitioned by (``gid``, ``_salt``), and ``_salt`` follows
    from (``gid``, ``sid``): grouping by those needs no further shuffle.
    """
    salts = shuffle_partitions(uses.sparkSession)
    hot = hot_keys(uses, "gid", rows)
    left = uses.select("gid", "sid", *keep).withColumn("_salt", salt("gid", F.col("sid"), hot, salts))
    return left.join(all_salts(words, "gid", hot, salts), ["gid", "_salt"])


def last_seen(columns: list[str]):
    """A partition function for rows sorted by term, record, item.

    It holds one counter set: occurrences, records, and the record (and item) seen
    last. A row of the record seen last adds no record; one that also repeats the
    item was delivered twice and adds nothing. A counter leaves when its term ends.
    """
    term, record, item, uses = columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple | None = None  # term, record, item as arrays of one
        occurrences = records = 0
        names = [term, "occurrences", "records"]

        def out(terms: pa.Array, o: np.ndarray, r: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([terms, pa.array(o, pa.int64()), pa.array(r, pa.int64())], names)

        for batch in batches:
            n = batch.num_rows
            if n == 0:
                continue
            cols = [batch.column(batch.schema.get_field_index(c)) for c in (term, record, item)]

            def changed(i: int) -> np.ndarray:
                own, flags = cols[i], np.ones(n, dtype=bool)
                if n > 1:
                    flags[1:] = pc.not_equal(own.slice(1), own.slice(0, n - 1)).fill_null(True).to_numpy(zero_copy_only=False)
                if last is not None:
                    flags[0] = not own.slice(0, 1).equals(last[i])
                return flags

            new_term = changed(0)
            new_record = new_term | changed(1)
            new_item = new_record | changed(2)
            used = pc.fill_null(batch.column(batch.schema.get_field_index(uses)), 0).to_numpy(zero_copy_only=False)
            used = np.where(new_item, used, 0)
            starts = np.flatnonzero(new_term)
            if starts.size == 0 or starts[0] != 0:  # the open term goes on
                head = int(starts[0]) if starts.size else n
                occurrences += int(used[:head].sum())
                records += int(new_record[:head].sum())
            if starts.size:
                if last is not None:
                    yield out(last[0], np.array([occurrences]), np.array([records]))
                o, r = np.add.reduceat(used, starts), np.add.reduceat(new_record.astype(np.int64), starts)
                if starts.size > 1:
                    yield out(cols[0].take(pa.array(starts[:-1])), o[:-1], r[:-1])
                occurrences, records = int(o[-1]), int(r[-1])
            last = tuple(c.slice(n - 1, 1) for c in cols)
        if last is not None:
            yield out(last[0], np.array([occurrences]), np.array([records]))

    return run


def count_terms(rows: DataFrame, term: str, record: str, item: str, uses: str, hot: list) -> DataFrame:
    """Occurrences and records of every value of ``term``.

    Rows are hash-partitioned by term, a hot term further by record, and sorted by
    record; each task keeps last-seen counters (see :func:`last_seen`), never a set
    of records. Counters of one hot term cover different records, so they add up.

    Rows without term or record are left out; null ``uses`` count as none; repeated
    (term, record, item) rows count once; an empty input gives an empty result.
    """
    salts = shuffle_partitions(rows.sparkSession)
    own = rows.select(term, record, item, uses).where(F.col(term).isNotNull() & F.col(record).isNotNull())
    placed = own.repartition(salts, F.col(term), salt(term, F.col(record), hot, salts)).sortWithinPartitions(term, record, item)
    kind = rows.schema[term].dataType.simpleString()
    partial = placed.mapInArrow(last_seen([term, record, item, uses]), f"`{term}` {kind}, occurrences bigint, records bigint")
    return partial.groupBy(term).agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))


def term_frequency(speech_ngrams: DataFrame, ngrams: DataFrame, rare_records: int = 2, common_share: float = 0.1) -> DataFrame:
    """``term``, ``uses``, ``speeches``, ``mark`` of every term that occurs.

    ``mark`` is ``rare`` up to ``rare_records`` speeches, ``common`` above
    ``common_share`` of all speeches of ``speech_ngrams``, else ``useful``.

    Spellings of one term share the smallest ``gid`` as their number, so the large
    shuffle carries numbers, and the term's text is joined to the counters only.
    A row delivered twice (same speech and ``gid``) counts once.
    """
    uses = speech_ngrams.select("sid", "gid", F.col("uses").cast("long").alias("uses")).where("sid is not null")
    rows = uses.count()
    records = uses.select("sid").distinct().count()
    words = vocabulary(ngrams)
    terms = words.groupBy("term").agg(F.min("gid").alias("term_id"))
    numbered = words.join(terms, "term").select("gid", "term_id")
    found = with_terms(uses, numbered, rows, ["uses"])
    counted = count_terms(found, "term_id", "sid", "gid", "uses", hot_keys(uses.withColumnRenamed("gid", "term_id"), "term_id", rows))
    mark = F.when(F.col("records") <= rare_records, "rare").when(F.col("records") > F.lit(common_share) * F.lit(records), "common").otherwise("useful")
    return counted.join(terms, "term_id").select("term", F.col("occurrences").alias("uses"), F.col("records").alias("speeches"), mark.alias("mark"))


def top_terms(speech_ngrams: DataFrame, ngrams: DataFrame, k: int = 5) -> DataFrame:
    """``pid``, ``session_uid``, ``rank_no``, ``term``, ``uses``: each person's ``k`` most used terms in each sitting.

    Rows without person or sitting or with an unknown ``gid`` are left out, rows
    delivered twice count once. Terms are numbered in code-point order first, so the shuffles carry
    numbers whose order is that of the terms, and text is joined to the result only. One shuffle on ``gid``
    serves the join and the removal of repeats; sums combine before the second; the group limit prunes
    before and after the third. Ties go to the smaller term in code-point order.
    """
    rows = speech_ngrams.where("pid is not null and session_uid is not null")
    keep = ["pid", "session_uid", "uses"]
    words = checkpoint(vocabulary(ngrams))
    terms = checkpoint(numbered(words.select("term").distinct(), ["term"], "term_no"))
    found = with_terms(rows, words.join(terms, "term").select("gid", "term_no"), rows.count(), keep)
    once = found.groupBy("gid", "_salt", "sid", "pid", "session_uid", "term_no").agg(F.max("uses").alias("uses"))
    summed = once.groupBy("pid", "session_uid", "term_no").agg(F.sum("uses").alias("uses"))
    best = top_k(summed, ["pid", "session_uid"], [F.desc_nulls_last("uses"), F.asc("term_no")], k)
    return best.join(broadcast_if_small(terms, 20_000), "term_no").select("pid", "session_uid", "rank_no", "term", "uses")
