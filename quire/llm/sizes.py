"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
import functools
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.session import shipped

#: Folder of the tokenizer files, the same on every machine, and the byte-level vocabulary used.
FOLDER = "/opt/tokenizers"
VOCABULARY = "byte_bpe_multi_50k.tiktoken"
# Fixed value: how byte-level BPE vocabularies of this kind split text first.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@functools.cache
def encoding(path: str):
    """The tokenizer of a file of ranks, loaded once a process."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines)}
    return tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(text: str, path: str) -> int:
    return len(encoding(path).encode_ordinary(text))


def token_sizes(df: DataFrame, text: str, keep: list[str], folder: str = FOLDER, vocabulary: str = VOCABULARY) -> DataFrame:
    """Columns ``keep`` and ``tokens``, the size of the whole text; rows with null text are left out.

    An empty text has size 0. The name ``tokens`` must not be among ``keep``.
    """
    path = f"{folder}/{vocabulary}"

    @F.pandas_udf("bigint")
    def size(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = encoding(path).encode_ordinary
        for s in parts:
            yield pd.Series([len(encode(t)) for t in s], dtype="int64")

    return shipped(df).filter(F.col(text).isNotNull()).select(*keep, size(F.col(text)).alias("tokens"))
