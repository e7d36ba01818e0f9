"""Bloom filters, so that a join shuffles only rows that it may find. The join still decides; a filter never loses a row."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from quarry.llm.common import Batches, stored

#: Powers of two between which the number of bits lies: 8 kB to 16 MB, which is what a filter takes in a broadcast.
FEWEST, MOST = 16, 27
#: Bits of a key's hash at which its places begin.
_PROBES = (0, 21, 37)


def _places(key: Column, bits: int) -> list[Column]:
    h = F.xxhash64(key)
    return [F.shiftrightunsigned(h, at).bitwiseAND(F.lit((1 << bits) - 1)) for at in _PROBES]


class Bloom:
    """Which keys may be among those of a table: 16 to 32 bits for each, fewer for over 8 million keys. Null is a key."""

    def __init__(self, keys: DataFrame, key: str, most: int = MOST) -> None:
        self.bits = bits = min(most, max(FEWEST, (16 * keys.count()).bit_length()))

        def dense(batches: Batches) -> Batches:
            words = np.zeros(1 << bits - 6, np.int64)
            for b in batches:
                words[b.column(0).to_numpy()] = b.column(1).to_numpy()
            yield pa.record_batch([pa.array([words], pa.list_(pa.int64()))], ["words"])

        places = keys.select(F.explode(F.array(*_places(F.col(key), bits))).alias("p"))
        bit = F.expr("shiftleft(1L, cast(p & 63 as int))")
        words = places.groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(bit).alias("v"))
        self.row = stored(words.repartition(1).mapInArrow(dense, "words array<long>"), "bloom").toDF("__words")

    def _may_have(self, key: str) -> Column:
        out = F.lit(True)
        for p in _places(F.col(key), self.bits):
            word = F.get(F.col("__words"), F.shiftright(p, 6).cast("int"))
            out = out & (F.call_function("shiftrightunsigned", word, p.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1)) == 1)
        return out

    def maybe(self, rows: DataFrame, key: str) -> DataFrame:
        """The rows whose key may be among the table's."""
        return rows.join(F.broadcast(self.row), self._may_have(key), "left_semi")

    def never(self, rows: DataFrame, key: str) -> DataFrame:
        """The other rows, whose key surely is not."""
        return rows.join(F.broadcast(self.row), self._may_have(key), "left_anti")
