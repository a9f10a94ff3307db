"""A Bloom filter of fixed largest size, to drop rows that cannot join before they are shuffled.

It only saves work: rows that pass by chance are left to the join behind it, and a filter that is
too small for its keys just lets more rows pass.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

#: Bits of a filter, at most: 16 MB, whatever the number of keys.
MOST_BITS = 1 << 27


def _places(key: Column, bits: int) -> list[Column]:
    return [F.pmod(key, F.lit(bits)), F.pmod(F.xxhash64(key, F.lit(1)), F.lit(bits))]


def held(table: np.ndarray, *places: np.ndarray) -> np.ndarray:
    """Which rows may be among the keys, by their places in a filter's table."""
    hit = np.ones(len(places[0]), bool)
    for p in places:
        hit &= (table[p >> 6] >> (p & 63).astype(np.uint64)) & np.uint64(1) != 0
    return hit


class Sieve:
    """``Sieve(keys, "k").keep(rows, "k")``: rows whose k may be among the keys (long, not null)."""

    def __init__(self, keys: DataFrame, column: str):
        n = keys.count()
        self.bits = min(MOST_BITS, 1 << max(10, int(16 * n).bit_length()))
        place = F.explode(F.array(*_places(F.col(column), self.bits)))
        words = keys.select(place.alias("p")).groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("b")).toArrow()
        table = np.zeros(max(1, self.bits >> 6), np.uint64)
        table[words["w"].to_numpy().astype(np.int64)] = words["b"].to_numpy().astype(np.int64).view(np.uint64)
        self.shared = keys.sparkSession.sparkContext.broadcast(table)

    def may_hold(self, column: str) -> Column:
        shared = self.shared

        @F.pandas_udf("boolean")
        def test(a: pd.Series, b: pd.Series) -> pd.Series:
            return pd.Series(held(shared.value, a.to_numpy(np.int64), b.to_numpy(np.int64)))

        return test(*self.places(column))

    def places(self, column: str) -> list[Column]:
        """The places of a key, for tasks that look them up in ``shared`` on their own."""
        return _places(F.col(column), self.bits)

    def keep(self, rows: DataFrame, column: str) -> DataFrame:
        return rows.where(self.may_hold(column))


def key_of() -> Column:
    """A long for doc_id and tie together."""
    return F.xxhash64("doc_id", "tie")
