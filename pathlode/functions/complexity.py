"""Lempel-Ziv complexity and compression distance: algorithms without a native form, as Arrow UDFs."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def lz76_phrases(data: bytes) -> int:
    """Phrases of the LZ76 parsing: each is the longest match within what came before it, plus one byte."""
    n, at, phrases = len(data), 0, 0
    while at < n:
        size = seen = 0
        # a longer match begins no earlier than the first one of its beginning
        while at + size < n and (seen := data.find(data[at : at + size + 1], seen, at)) >= 0:
            size += 1
        at += size + 1
        phrases += 1
    return phrases


def lz76_complexity(data: bytes) -> float:
    """Phrases over n / log2 n, between 0 and 1; 0 for fewer than two bytes."""
    n = len(data)
    return 0.0 if n < 2 else min(1.0, lz76_phrases(data) / (n / math.log2(n)))


@F.pandas_udf(T.DoubleType())
def lz_complexity(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else lz76_complexity(t.encode()))


@F.pandas_udf(T.IntegerType())
def zstd_size(texts: pd.Series) -> pd.Series:
    import zstandard

    press = zstandard.ZstdCompressor(level=3)
    return texts.map(lambda t: len(press.compress((t or "").encode())))


def ncd(size_a, size_b, size_both):
    """Normalised compression distance from compressed sizes; 0 at least."""
    return F.greatest(F.lit(0.0), (size_both - F.least(size_a, size_b)) / F.greatest(size_a, size_b))
