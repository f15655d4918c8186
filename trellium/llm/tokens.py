"""Token counts of a public tokenizer."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Where the vocabulary files are; TRELLIUM_TOKENIZERS overrides, a parameter does so again.
DEFAULT_DIR = os.environ.get("TRELLIUM_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"
# Fixed value: the splitting pattern that belongs to the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Texts are encoded in pieces of about this many characters, cut before a space that follows a letter, where the pattern splits too.
PIECE = 1 << 18


@lru_cache(maxsize=2)
def encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(text: str, path: str) -> int:
    """Tokens of a whole text; very long ones piece by piece."""
    enc = encoding(path)
    total = at = 0
    while len(text) - at > PIECE:
        cut = at + PIECE
        # a single space between two letters starts a token of its own
        while cut < len(text) - 1 and not (text[cut] == " " and text[cut - 1].isalpha() and text[cut + 1].isalpha()):
            cut += 1
        if cut >= len(text) - 1:
            break
        total += len(enc.encode_ordinary(text[at:cut]))
        at = cut
    return total + len(enc.encode_ordinary(text[at:]))


def token_count(text: Column, directory: str = DEFAULT_DIR, vocabulary: str = VOCABULARY) -> Column:
    """Number of tokens (bigint) of a text; 0 for NULL and empty texts."""
    path = os.path.join(directory, vocabulary)

    @F.pandas_udf("bigint")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([count_tokens(v, path) if v else 0 for v in s], dtype="int64")

    return run(text)
