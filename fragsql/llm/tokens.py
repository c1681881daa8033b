"""Sizes of texts in tokens of a public tokenizer, whose vocabulary file is a parameter."""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A byte-level BPE of many languages; every executor needs the file at this place.
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: How texts are cut before the merges of a .tiktoken file.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=4)
def encoder(path: str = VOCABULARY) -> Callable[[str], list[int]]:
    """The ids of a text, by a .tiktoken, .json or .model file. Strings of special tokens are ordinary text."""
    if path.endswith(".tiktoken"):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        return tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    if path.endswith(".json"):
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.encode_special_tokens = True
        return lambda text: t.encode(text, add_special_tokens=False).ids
    if path.endswith(".model"):
        import sentencepiece

        return sentencepiece.SentencePieceProcessor(model_file=path).encode
    raise ValueError(f"no tokenizer for {path}")


def token_count(text: str | Column, vocabulary: str = VOCABULARY) -> Column:
    """Tokens of a whole text; 0 for null and for the empty text."""

    @F.pandas_udf("long")
    def count(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = encoder(vocabulary)
        for batch in texts:
            yield batch.map(lambda t: len(encode(t)) if t else 0)

    return count(text)


def with_token_count(df: DataFrame, text: str, out: str = "n_tokens", vocabulary: str = VOCABULARY) -> DataFrame:
    return df.withColumn(out, token_count(text, vocabulary))
