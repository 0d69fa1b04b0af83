"""Bloom filters that keep rows which no join can need out of a shuffle.

A filter is broadcast, so its size has a bound, ``MOST_BITS``: up to 2**25 keys it lets through about one of a hundred
rows that it should not, beyond that gradually more.  It only saves shuffling; an exact join of what passes follows, at
every size.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lathe.llm import textops

BITS_PER_KEY = 16
#: 64 MB.
MOST_BITS = 1 << 29
#: Words of 64 bits sent together while a filter is added up.
BLOCK = 512
_TABLE = "block int, bits binary"


def _places(keys: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The word of each key and its four bits there."""
    h = textops.mix(keys.astype(np.int64).view(np.uint64) + np.uint64(textops.MULTIPLIERS[4]))
    bits = np.zeros(len(h), np.uint64)
    for k in range(4):
        bits |= np.uint64(1) << ((h >> np.uint64(6 * k)) & np.uint64(63))
    return ((textops.mix(h) >> np.uint64(20)) % np.uint64(words)).astype(np.int64), bits


def build(keys: DataFrame):
    """A broadcast filter of the first column of ``keys``, 64-bit integers."""
    n = keys.count()
    words = min(MOST_BITS, max(64 * BLOCK, 1 << (BITS_PER_KEY * n).bit_length())) // 64

    def send(batches):
        own = np.zeros(words, np.uint64)
        for batch in batches:
            at, bits = _places(batch.column(0).to_numpy(), words)
            np.bitwise_or.at(own, at, bits)
        parts = own.reshape(-1, BLOCK)
        some = np.flatnonzero(parts.any(axis=1))
        if len(some):
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([parts[i].tobytes() for i in some], pa.binary())], ["block", "bits"])

    def add(table: pa.Table) -> pa.Table:
        total = np.bitwise_or.reduce([np.frombuffer(b, np.uint64) for b in table.column("bits").to_pylist()])
        return pa.table({"block": pa.array([table.column("block")[0].as_py()], pa.int32()), "bits": pa.array([total.tobytes()], pa.binary())})

    found = keys.select(F.col(keys.columns[0]).cast("long")).filter(F.col(keys.columns[0]).isNotNull()).mapInArrow(send, _TABLE).groupBy("block").applyInArrow(add, _TABLE).toArrow()
    whole = np.zeros(words, np.uint64)
    for block, bits in zip(found.column("block").to_pylist(), found.column("bits").to_pylist()):
        whole.reshape(-1, BLOCK)[block] = np.frombuffer(bits, np.uint64)
    return keys.sparkSession.sparkContext.broadcast(whole)


def may_hold(shared, key: Column) -> Column:
    """False only for keys that are not in the filter; false for null."""

    @F.pandas_udf("boolean")
    def look(values: pd.Series) -> pd.Series:
        table = shared.value
        at, bits = _places(values.fillna(0).to_numpy(), len(table))
        return pd.Series(((table[at] & bits) == bits) & values.notna().to_numpy())

    return look(key)


def semi_join(df: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    """The rows of ``df`` whose ``column`` is in ``keys`` (one column of that name); only rows that may match are shuffled."""
    return df.filter(may_hold(build(keys), F.col(column))).join(keys, column, "left_semi")
