"""Token counts of rendered text under a byte-pair vocabulary, for reports."""

from __future__ import annotations

import base64
import os

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_ENCODINGS: dict = {}


def _encoding(ranks_path: str, pattern: str):
    if ranks_path not in _ENCODINGS:
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
        _ENCODINGS[ranks_path] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _ENCODINGS[ranks_path]


def tokens(c: Column, ranks_path: str | None = None, pattern: str | None = None) -> Column:
    """Tokens under a rank file; without one, or where it can't be read, a quarter of the characters."""
    if not ranks_path or not pattern or not os.path.exists(ranks_path):
        return F.floor(F.length(c) / 4).cast("bigint")

    @F.pandas_udf("bigint")
    def count(texts: pd.Series) -> pd.Series:
        encoding = _encoding(ranks_path, pattern)
        return texts.map(lambda t: None if t is None else len(encoding.encode_ordinary(t))).astype("Int64")

    return count(c)
