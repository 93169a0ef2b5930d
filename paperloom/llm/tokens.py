"""Sizes of texts in tokens of a public tokenizer.

The vocabulary is a file of ranks; its path is a parameter (Spark setting
``spark.paperloom.tokenizer``) and must be readable on every worker. Null texts
have no tokens. Texts are encoded whole.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SETTING, DEFAULT = "spark.paperloom.tokenizer", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Fixed value: the public pattern that cuts a text before byte pairs are merged.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_encodings: dict = {}


def encoding(path: str):
    """The tokenizer of a file, read once in each worker."""
    if path not in _encodings:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
        _encodings[path] = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encodings[path]


def vocabulary(spark: SparkSession) -> str:
    return spark.conf.get(SETTING, None) or DEFAULT


def counted(df: DataFrame, text: str = "text", out: str = "n_tokens", path: str | None = None) -> DataFrame:
    """``df`` with the number of tokens of a column of texts."""
    path = path or vocabulary(df.sparkSession)

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = encoding(path).encode_ordinary
        for texts in batches:
            yield pd.Series([len(encode(t)) if isinstance(t, str) and t else 0 for t in texts], dtype="int64")

    return df.withColumn(out, count(F.col(f"`{text}`")))
