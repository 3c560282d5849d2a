"""Public tokenizers: vocabulary files are read from a folder given as a parameter, on each executor, and kept there."""

from __future__ import annotations

import base64
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Where the vocabulary files lie; every operator takes it as ``tokenizer_dir``.
TOKENIZER_DIR = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
# Fixed value: the public pre-tokenization pattern of the byte-level BPE vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=4)
def encoding(tokenizer_dir: str = TOKENIZER_DIR, vocabulary: str = VOCABULARY):
    import tiktoken

    with open(f"{tokenizer_dir}/{vocabulary}", "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_count(c: str | Column, tokenizer_dir: str = TOKENIZER_DIR) -> Column:
    """Number of tokens of the whole text; null and empty texts have 0."""

    @F.pandas_udf("long")
    def count(s: pd.Series) -> pd.Series:
        e = encoding(tokenizer_dir)
        return s.map(lambda t: len(e.encode_ordinary(t)) if t else 0).astype("int64")

    return count(c)
