"""Shard routing by FNV-1a hashing and jump consistent hashing."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_SHARDS = 256
_OFFSET, _PRIME = 0xCBF29CE484222325, 0x100000001B3
_M = (1 << 64) - 1


def fnv1a64(data: bytes) -> int:
    h = _OFFSET
    for b in data:
        h = ((h ^ b) * _PRIME) & _M
    return h


def jump(key: int, n: int) -> int:
    """Lamping and Veach's jump consistent hash."""
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) & _M
        j = int((b + 1) * ((1 << 31) / ((key >> 33) + 1)))
    return b


def shard_of(column: str | Column, n: int) -> Column:
    """The shard (int, from 0) of a text key; null keys have none."""
    if not 1 <= n <= MAX_SHARDS:
        raise ValueError(f"1 to {MAX_SHARDS} shards")

    @F.pandas_udf("int")
    def route(keys: pd.Series) -> pd.Series:
        places, distinct = pd.factorize(keys)
        table = np.array([jump(fnv1a64(k.encode()), n) for k in distinct] + [-1])
        out = pd.Series(table[places], dtype="Int32")
        return out.where(out >= 0)

    return route(F.col(column).cast("string") if isinstance(column, str) else column.cast("string"))
