"""Token ids of public tokenizers."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The pre-tokenizer pattern that belongs to the vocabulary (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def encoder(path: str = TOKENIZER):
    """The encode function of a vocabulary file (.tiktoken, .model or .json), loaded once per worker process."""
    # functions are shipped by value, so a variable of this module would start empty in every task and carry the driver's encoder
    encoders = sys.__dict__.setdefault("_stepmill_encoders", {})
    if path not in encoders:
        if path.endswith(".tiktoken"):
            import base64

            import tiktoken

            with open(path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
            encoders[path] = tiktoken.Encoding("stepmill", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        elif path.endswith(".model"):
            import sentencepiece

            sp = sentencepiece.SentencePieceProcessor(model_file=path)
            encoders[path] = lambda text: sp.encode(text, num_threads=1)
        else:
            from tokenizers import Tokenizer

            t = Tokenizer.from_file(path)
            t.encode_special_tokens = True
            encoders[path] = lambda text: t.encode(text, add_special_tokens=False).ids
    return encoders[path]


def token_ids(text: Column, path: str = TOKENIZER) -> Column:
    """ARRAY<INT> of the tokens of a text; NULL stays NULL."""

    @F.pandas_udf("array<int>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        of = encoder(path)
        for s in batches:
            yield s.map(lambda x: None if x is None else of(x))

    return encode(text)
