"""Membership filters of a fixed size over 64-bit hashes.

A filter says "no" only for values that were not put in. It thins out rows before an exact
join; when far more values go in than it has bits, it says "yes" more often and the join
has more to do, but results do not change. Its size never grows with the data.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 25     # 2^25 bits are 4 MB


def build(values: DataFrame, column: str, bits: int = BITS) -> np.ndarray:
    """uint64 words of a filter over `column` (long). At most 2^bits / 64 rows reach the driver."""
    place = F.col(column).bitwiseAND(F.lit((1 << bits) - 1).cast("long"))
    rows = (values.select(place.alias("place"))
        .select(F.shiftright("place", 6).alias("word"), F.expr("shiftleft(1L, CAST(place & 63 AS INT))").alias("bit"))
        .groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow())
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[rows["word"].to_numpy()] = rows["bits"].to_numpy().view(np.uint64)
    return out


def contains(words: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Whether each uint64 value may have been put in."""
    place = values & np.uint64(len(words) * 64 - 1)
    return (words[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1) != 0
