"""Words of whole texts as arrays of hashes, straight from Arrow buffers.

A word is a run of bytes outside a set of separators. Every word gets a 64-bit hash that depends
on its bytes alone, so equal words have equal hashes in every task. Texts are read in chunks of
bounded size, whole documents at a time, so a task's memory does not grow with its partition.
"""

from __future__ import annotations

import ctypes
import gc
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
#: glibc's call that returns free memory; other systems have none.
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)
_BASE = U64(0x9E3779B97F4A7C15)
_BASE_INVERSE = U64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: A random value for each byte, from a fixed seed.
_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)

CHUNK_BYTES = 1 << 19
CHUNK_DOCUMENTS = 1 << 18

#: Rows and bytes of an Arrow batch of texts, at most. Texts can be long, and workers are small.
BATCH_ROWS = 1_000
BATCH_BYTES = 8 << 20


def bound_batches(spark: SparkSession) -> None:
    """Lower the session's limits on Arrow batches where they are above those of this package."""
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        name = f"spark.sql.execution.arrow.{name}"
        now = int(re.sub(r"[bB]$", "", spark.conf.get(name)))
        if not 0 < now <= most:
            spark.conf.set(name, str(most))


_bytes = np.arange(256)
#: Words end at the space and at bytes 9 to 13 only.
SPACES = (_bytes == 32) | ((_bytes >= 9) & (_bytes <= 13))
#: Words are letters, digits and everything outside ASCII.
NOT_ALNUM = ~(
    ((_bytes >= 48) & (_bytes <= 57)) | ((_bytes >= 65) & (_bytes <= 90))
    | ((_bytes >= 97) & (_bytes <= 122)) | (_bytes >= 128)
)
LOWER = np.where((_bytes >= 65) & (_bytes <= 90), _bytes + 32, _bytes).astype(np.uint8)


def give_back() -> None:
    """Return what allocators and growing arrays of this process keep to the system."""
    for powers in (BYTES, WORDS, WORDS_2):
        powers.up = powers.down = np.ones(1, U64)
    gc.collect()
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def tidy(emit):
    """A function over Arrow batches that gives its memory back at its end.

    Workers live on from task to task, and what allocators keep of each adds up over a session.
    """
    @wraps(emit)
    def run(batches):
        try:
            yield from emit(batches)
        finally:
            give_back()

    return run


def byte_values(data: np.ndarray) -> np.ndarray:
    """The random value of each byte, as sums of ``BYTES`` need them."""
    return _BYTE[data]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit of a hash over all bits."""
    x = (x ^ (x >> U64(33))) * U64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> U64(33))) * U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U64(33))


class Powers:
    """Powers of an odd base and of its inverse modulo 2**64, kept up to the longest use."""

    def __init__(self, base: int):
        self.base, self.inverse = U64(base), U64(pow(base, -1, 1 << 64))
        self.up = self.down = np.ones(1, U64)

    def grow(self, n: int) -> Powers:
        if len(self.up) < n:
            with np.errstate(over="ignore"):
                ones = np.full(max(n, 2 * len(self.up)), self.base)
                ones[0] = 1
                self.up = np.cumprod(ones, dtype=U64)
                ones = np.full(len(ones), self.inverse)
                ones[0] = 1
                self.down = np.cumprod(ones, dtype=U64)
        return self

    def prefix(self, values: np.ndarray) -> np.ndarray:
        """Sums whose differences, see ``of``, are hashes of any stretch."""
        self.grow(len(values) + 1)
        out = np.zeros(len(values) + 1, U64)
        np.cumsum(values * self.up[: len(values)], out=out[1:], dtype=U64)
        return out

    def of(self, prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((prefix[ends] - prefix[starts]) * self.down[starts])


BYTES = Powers(0x9E3779B97F4A7C15)
WORDS = Powers(0xD1342543DE82EF95)
WORDS_2 = Powers(0xAF251AF3B0F025B5)


@dataclass
class Chunk:
    """Words of the documents ``first`` to ``first + len(offsets) - 1`` of a batch."""

    first: int
    offsets: np.ndarray  # first word of each document, and the count of words at the end
    hashes: np.ndarray
    starts: np.ndarray  # byte positions in ``data``
    ends: np.ndarray
    data: np.ndarray
    bounds: np.ndarray  # first byte of each document, and the count of bytes at the end

    @property
    def documents(self) -> int:
        return len(self.offsets) - 1

    def document_of(self) -> np.ndarray:
        return np.repeat(np.arange(self.documents), np.diff(self.offsets))


def chunks(texts: pa.Array, separators: np.ndarray = SPACES, fold: np.ndarray | None = None,
           limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """Words of a column of texts. A null is an empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    n = len(texts)
    if not n:
        return
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset: texts.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        last = min(n, first + CHUNK_DOCUMENTS, max(first + 1, last))
        yield _chunk(first, data[offsets[first]: offsets[last]],
                     offsets[first: last + 1] - offsets[first], separators, fold)
        first = last


def _chunk(first, data, bounds, separators, fold) -> Chunk:
    if fold is not None:
        data = fold[data]
    inside = ~separators[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    edges = bounds[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]  # documents meet here: a word never crosses
    begins[edges] = inside[edges]
    ends[edges - 1] = inside[edges - 1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    with np.errstate(over="ignore"):
        hashes = BYTES.of(BYTES.prefix(_BYTE[data]), starts, ends)
    return Chunk(first, np.searchsorted(starts, bounds), hashes, starts, ends, data, bounds)


def plain_names(df: DataFrame) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``df`` without column names that operators use inside, and a way back to the old columns.

    Those names begin with an underscore.
    """
    taken, new = {c.lower() for c in df.columns}, []
    for i, c in enumerate(df.columns):
        name = c
        while name.startswith("_") or (name != c and name.lower() in taken):
            name = f"extra{i}{name}"
        new.append(name)
    old = df.columns
    return df.toDF(*new), lambda out: out.select(*new).toDF(*old)


def document_key(df: DataFrame, key: str = "_key", doc_id: str = "doc_id",
                 text: str = "text") -> DataFrame:
    """``df`` with an integer that stands for the document.

    The doc_id; where that is null a negative number made from the text, so equal texts without
    an id count as one document. Rows that repeat an id are one document as well.
    """
    # Bit 63 set: null ids sort before the others.
    made = F.xxhash64(F.coalesce(F.col(text), F.lit(""))).bitwiseOR(F.lit(-(1 << 63)))
    return df.withColumn(key, F.coalesce(F.col(doc_id).cast("long"), made))
