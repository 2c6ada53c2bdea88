"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

#: Speakers whose turns bear loss in a chat, and all speakers.
ANSWERS = ("Agent", "助手")
_TURN = re.compile(r"(?m)^(?=(?:User|Agent|用户|助手): )")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def counter(vocabulary: str | None = None) -> Callable[[str], int]:
    """A function from text to its number of tokens.

    The vocabulary (lines of a base64 token and its rank) is read here, on the driver, and travels with the function,
    so executors need no file. Special tokens in a text are ordinary text.
    """
    path = vocabulary or default_vocabulary()
    if not os.path.exists(path):
        raise ValueError(f"no vocabulary at {path}")
    with open(path, "rb") as file:
        content = file.read()
    import public_tokenizers

    return _Counter(content, public_tokenizers.PATTERN)


class _Counter:
    _cache: dict = {}

    def __init__(self, content: bytes, pattern: str) -> None:
        self.content, self.pattern = content, pattern

    def __call__(self, text: str) -> int:
        key = len(self.content), self.pattern
        if key not in self._cache:
            import tiktoken

            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, self.content.splitlines())}
            self._cache[key] = tiktoken.Encoding("own", pat_str=self.pattern, mergeable_ranks=ranks, special_tokens={})
        return len(self._cache[key].encode_ordinary(text))


def turns(text: str) -> list[tuple[str, bool]]:
    """Parts of a text and whether they bear loss: of a chat the answers, of anything else the whole."""
    parts = [p for p in _TURN.split(text) if p]
    if len(parts) < 2:
        return [(text, True)]
    return [(p, p.startswith(ANSWERS)) for p in parts]


def sized(documents: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, sizes array<int>, loss array<boolean>): tokens of each part of each text, in order. Null and empty texts are left out."""
    count = counter(vocabulary)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            parts = [turns(t) for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "sizes": [[count(p) for p, _ in ps] for ps in parts], "loss": [[b for _, b in ps] for ps in parts]})

    return documents.where("text IS NOT NULL AND text != ''").select("doc_id", "text").mapInPandas(run, "doc_id bigint, sizes array<int>, loss array<boolean>")
