"""Themes of texts from two sources: what heads them, else what they say."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from plenaria.functions.speech import Rule, RuleBook


def attributed(df: DataFrame, key: str, titles: str, text: str, rules: list[Rule], parents: dict[str, str]) -> DataFrame:
    """``key``, ``theme``, ``method`` (``debate`` or ``text``), ``hits``, ``level`` (``theme`` or ``domain``).

    The themes of the folded ``titles`` stand for all that is said under them (``hits`` 0). Only where they name
    none (or too many to tell) is the folded ``text`` read for themes that it is about. Each theme also
    gives its domain (``parents``), once, by the better method and with the hits of its themes together.
    Null titles and texts name nothing.
    """

    def read(titled: str, said: str, book: RuleBook) -> list[tuple[str, str, int, str]]:
        themes = {t: 0 for t in book.title_themes(titled)}
        method = "debate" if themes else "text"
        if not themes:
            themes = {t: c.total() for t, c in book.text_themes(said).items()}
        domains: dict[str, int] = {}
        for t, n in themes.items():
            if t in parents:
                domains[parents[t]] = domains.get(parents[t], 0) + n
        return [(t, method, n, "theme") for t, n in sorted(themes.items())] + [(d, method, n, "domain") for d, n in sorted(domains.items())]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        book = RuleBook(rules)
        for batch in batches:
            rows = [(k, *found) for k, a, b in zip(batch[key], batch[titles].fillna(""), batch[text].fillna("")) for found in read(a, b, book)]
            yield pd.DataFrame(rows, columns=[key, "theme", "method", "hits", "level"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, titles, text).mapInPandas(run, f"`{key}` {kind}, theme string, method string, hits int, level string")
