"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The tokenizer's file, at the same place on every machine.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
_LOADED: dict[str, object] = {}


def tokenizer(path: str):
    """The tokenizer of a file, loaded once for each worker."""
    if path not in _LOADED:
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if not Path(path).exists():
            raise FileNotFoundError(f"no tokenizer at {path}")
        loaded = Tokenizer.from_file(path)
        loaded.encode_special_tokens = True  # their spellings in a text are ordinary text
        _LOADED[path] = loaded
    return _LOADED[path]


# Fixed value: the public pattern by which byte-level BPE cuts a text before merging.
CUTS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters of cuts whose tokens a task remembers; forgetting them costs time only.
REMEMBERED = 20_000_000


def cuts_alone(path: str) -> bool:
    """Whether the tokenizer merges within CUTS only, so that a text has the tokens of its cuts."""
    plan = json.loads(Path(path).read_text(encoding="utf-8"))
    before, model = plan.get("pre_tokenizer") or {}, plan.get("model") or {}
    return (
        plan.get("normalizer") is None and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and model.get("type") == "BPE" and not model.get("dropout")
        and not model.get("ignore_merges") and all(t.get("special") for t in plan.get("added_tokens") or ())
    )


class Counter(dict):
    """Tokens of texts: each distinct cut is encoded once, a text has those of its cuts together."""

    def __init__(self, path: str) -> None:
        super().__init__()
        import regex

        self.encode = tokenizer(path).encode_batch_fast
        self.cut = regex.compile(CUTS).findall if cuts_alone(path) else None
        self.room = REMEMBERED

    def lengths(self, texts: list[str]) -> list[int]:
        return [len(e) for at in range(0, len(texts), 256) for e in self.encode(texts[at : at + 256], add_special_tokens=False)]

    def of(self, texts: list[str]) -> list[int]:
        if self.cut is None:
            return self.lengths(texts)
        cut = [self.cut(t) for t in texts]
        new = list({c for cuts in cut for c in cuts if c not in self})
        self.room -= sum(map(len, new))
        self.update(zip(new, self.lengths(new)))
        found = [sum(map(self.__getitem__, cuts)) for cuts in cut]
        if self.room < 0:
            self.clear()
            self.room = REMEMBERED
        return found


def token_counts(documents: DataFrame, key: str = "doc_id", text: str = "text", keep: list[str] | None = None, path: str = TOKENIZER) -> DataFrame:
    """``key``, ``keep`` and ``tokens`` of every row, over its whole text; null text has no token."""
    kept = [key, *(keep or [])]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count = Counter(path).of
        for batch in batches:
            texts = batch[text].fillna("").tolist()
            sizes = [n for at in range(0, len(texts), 256) for n in count(texts[at : at + 256])]
            yield batch[kept].assign(tokens=sizes)

    types = ", ".join(f"`{c}` {documents.schema[c].dataType.simpleString()}" for c in kept)
    return documents.select(*kept, text).mapInPandas(run, f"{types}, tokens bigint")
