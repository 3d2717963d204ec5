"""Token counts with a public tokenizer. Its vocabulary file is a parameter and stays where it is."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A file of base64 tokens and ranks; the pattern that splits words first (fixed values of the public vocabulary).
VOCABULARY = os.environ.get("TOKENIZER_FILE", "/opt/tokenizers/byte_bpe_50k.tiktoken")
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def encoder(path: str = VOCABULARY):
    """The encoding, once per worker process."""
    import tiktoken

    kept = tiktoken.__dict__.setdefault("_by_path", {})
    if path not in kept:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        kept[path] = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return kept[path]


def _count(path: str):
    def over(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(path)
        for pdf in batches:
            out = pdf.drop(columns="text")
            out["n_tokens"] = [len(enc.encode_ordinary(t)) if isinstance(t, str) else 0 for t in pdf["text"]]
            yield out

    return over


def with_token_counts(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """``docs`` without its column text, with ``n_tokens`` (0 for null)."""
    rest = [c for c in docs.columns if c != "text"]
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in rest)
    return docs.select(*rest, F.col("text")).mapInPandas(_count(path), f"{kinds}, n_tokens bigint")
