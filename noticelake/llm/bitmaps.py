"""A bitmap of fixed size over the low bits of a column: "surely absent" or "maybe there".

It prunes rows before a shuffle. Its size never depends on the data; a full bitmap prunes
nothing, and the join behind it stays exact.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 26  # 2**26 bits: 8 MB


def bitmap_of(df: DataFrame, column: str, bits: int = BITS) -> np.ndarray:
    """The bitmap of a long column, merged by Spark; at most 2**bits / 64 words reach the driver."""
    slot = F.col(column).bitwiseAND(F.lit((1 << bits) - 1))
    mask = F.expr(f"shiftleft(1L, CAST({column} & 63 AS INT))")
    words = (
        df.select(F.shiftright(slot, 6).alias("w"), mask.alias("m"))
        .groupBy("w").agg(F.bit_or("m").alias("m")).toArrow()
    )
    bitmap = np.zeros(1 << (bits - 6), np.uint64)
    bitmap[words["w"].to_numpy()] = words["m"].to_numpy().view(np.uint64)
    return bitmap


def maybe_in(bitmap: np.ndarray, values: np.ndarray) -> np.ndarray:
    slots = values.view(np.uint64) & np.uint64(len(bitmap) * 64 - 1)
    return (bitmap[(slots >> np.uint64(6)).astype(np.int64)] >> (slots & np.uint64(63))) & np.uint64(1) == 1
