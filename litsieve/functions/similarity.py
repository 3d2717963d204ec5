"""Similarities that Spark has no expression for."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def lcs_length(a: str, b: str) -> int:
    """Length of the longest common subsequence: one machine word operation per character of ``b``."""
    if len(a) < len(b):
        a, b = b, a
    where: dict[str, int] = {}
    for i, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for ch in b:
        m = where.get(ch, 0)
        u = row & m
        row = ((row + u) | (row - u)) & full
    return len(a) - row.bit_count()


def indel_ratio(a: str | None, b: str | None) -> float | None:
    """2 * LCS / (len a + len b); 1 for two empty strings, null for null."""
    if a is None or b is None:
        return None
    n = len(a) + len(b)
    return 2 * lcs_length(a, b) / n if n else 1.0


def indel(a: Column, b: Column) -> Column:
    """The Indel ratio of two columns, Arrow batch by batch."""

    @F.pandas_udf(T.DoubleType())
    def ratio(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([indel_ratio(p, q) for p, q in zip(x, y)], dtype="float64")

    return ratio(a, b)


def length_bound(a: Column, b: Column, least: float) -> Column:
    """False where the lengths alone keep the Indel ratio under ``least``."""
    la, lb = F.length(a), F.length(b)
    return F.least(la, lb) * (2 - least) >= F.greatest(la, lb) * least


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two arrays; null where a norm is 0."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(F.transform(v, lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda s, x: s + x))
    return dot / F.nullif(norm(a) * norm(b), F.lit(0.0))
