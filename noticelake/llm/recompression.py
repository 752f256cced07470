"""Substring dedup by recompression (operator 8).

Every round first names runs (a symbol four or more times in a row becomes: first, block, last)
and then pairs (a symbol of the left class followed by one of the right class, the classes by a
bit of the symbols' hashes). A name is a 64-bit hash of what it stands for, so names are global:
equal runs and pairs get equal names in every task without a shuffle for each round. Inside a
window, symbols near its ends may hang on the words outside; they are given up round by round by
rules that look at the window alone. The last of ``ROUNDS`` rounds in which ``CHAIN`` sure symbols
are left gives the window's anchor: its chain of symbols with the smallest hash. Equal windows
have the same chain at the same place. Shared chains reveal repeats, hashes of all words verify
them.

Defined results: null and empty texts have no words; texts are taken whole at any length; rows
with one doc_id are one document, rows without one are known by their text; an empty table gives
an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticelake.llm import tokens as tk
from noticelake.llm.repeats import apply_spans, kept_words, repeated_runs, word_spans

LENGTH = 20
ROUNDS = 2
CHAIN = 4
_PLACE_BITS = 28
_U = np.uint64


def _name_runs(x: np.ndarray, lo: np.ndarray, hi: np.ndarray):
    """One step on runs: new symbols, new places, and what each window still knows."""
    first_here = np.ones(len(x), bool)
    first_here[1:] = x[1:] != x[:-1]
    begins = np.flatnonzero(first_here)
    lengths = np.diff(np.append(begins, len(x)))
    run = np.cumsum(first_here, dtype=np.int32) - 1
    first = begins[run]
    last = first + lengths[run] - 1
    # The first run may go on to the left: only its last symbol is sure. The last one: its first.
    left, right = x[lo] == x[lo + 1], x[hi] == x[hi - 1]
    lo, hi = np.where(left, last[lo], lo), np.where(right, first[hi], hi)
    at = np.arange(len(x))
    long = lengths[run] > 3
    block = long & (at == first + 1)
    kept = ~long | (at <= first + 1) | (at == last)
    y = np.where(block, tk.mix(x ^ tk.mix((last - first - 1).astype(_U) + _U(0x1F83D9AB))), x)
    return y[kept], np.cumsum(kept, dtype=np.int32) - 1, lo, hi


def _name_pairs(x: np.ndarray, lo: np.ndarray, hi: np.ndarray, level: int):
    right_class = (tk.mix(x + _U(level + 1)) & _U(1)).astype(bool)
    pair = np.zeros(len(x), bool)
    pair[:-1] = ~right_class[:-1] & right_class[1:]
    lo = lo + right_class[lo]
    hi = hi - ~right_class[hi]
    kept = np.ones(len(x), bool)
    kept[1:] = ~pair[:-1]
    y = x.copy()
    at = np.flatnonzero(pair)
    y[at] = tk.mix(x[at] * _U(0x9E3779B97F4A7C15) + tk.mix(x[at + 1] + _U(0x6A09E667)))
    return y[kept], np.cumsum(kept, dtype=np.int32) - 1, lo, hi


def _smallest(x: np.ndarray, lo: np.ndarray, hi: np.ndarray):
    """For each stretch [lo, hi] of symbols its chain of ``CHAIN`` symbols with the smallest hash."""
    at = np.arange(len(x) - CHAIN + 1)
    chains = tk.WORDS.of(tk.WORDS.prefix(x), at, at + CHAIN)
    low = _U((1 << _PLACE_BITS) - 1)
    table = [(chains & ~low) | at.astype(_U)]  # leftmost on a tie
    choices = hi - lo + 2 - CHAIN
    while 2 << len(table) - 1 <= choices.max(initial=1):
        half = 1 << len(table) - 1
        table.append(np.minimum(table[-1][:-half], table[-1][half:]))
    best = np.empty(len(lo), _U)
    power = np.frexp(choices)[1] - 1
    for k in range(len(table)):
        mine = power == k
        left = lo[mine]
        best[mine] = np.minimum(table[k][left], table[k][left + choices[mine] - (1 << k)])
    place = (best & low).astype(np.int64)
    return place, chains[place]


def symbols(hashes: np.ndarray, starts: np.ndarray, length: int):
    """For each window the place and the name of its anchor."""
    x, lo, hi = hashes, starts, starts + length - 1
    place, name = np.empty(len(starts), np.int64), np.empty(len(starts), _U)
    alive = np.arange(len(starts))
    level = 0
    while True:
        # Windows that the next round would leave without a chain are settled in this one.
        after, lo2, hi2 = None, lo[:0], hi[:0]
        enough = np.zeros(len(alive), bool)
        if level < ROUNDS:
            more = np.flatnonzero(lo < hi)
            y, index, lo2, hi2 = _name_runs(x, lo[more], hi[more])
            sure = lo2 <= hi2
            more, lo2, hi2 = more[sure], index[lo2[sure]], index[hi2[sure]]
            after, index, lo2, hi2 = _name_pairs(y, lo2, hi2, level)
            sure = lo2 <= hi2
            more, lo2, hi2 = more[sure], index[lo2[sure]], index[hi2[sure]]
            sure = hi2 - lo2 + 1 >= CHAIN
            enough[more[sure]] = True
            lo2, hi2 = lo2[sure], hi2[sure]
        if not enough.all():
            at, names = _smallest(x, lo[~enough], hi[~enough])
            place[alive[~enough]] = np.int64(level << 40) + at
            name[alive[~enough]] = tk.mix(names + _U(level))
        alive, x, lo, hi = alive[enough], after, lo2, hi2
        level += 1
        if not len(alive):
            return place, name


def substring_spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Per document key the merged stretches of words to remove. ``docs`` has _key and text."""
    return word_spans(repeated_runs(docs, length, symbols), length)


@tk.tidy
def _digests(batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        n, gone, sha = [], [], []
        for chunk in tk.chunks(batch.column("text")):
            kept = kept_words(chunk, batch.column("_spans").slice(chunk.first, chunk.documents))
            # Kept words with one space behind each, cut out of the chunk's bytes at once.
            size = (chunk.ends - chunk.starts)[kept] + 1
            starts = chunk.starts[kept]
            ends = np.cumsum(size)
            take = np.arange(size.sum()) - np.repeat(ends - size, size) + np.repeat(starts, size)
            data = np.append(chunk.data, np.uint8(32))[take]
            data[ends - 1] = 32
            data = data.tobytes()
            upto = np.concatenate([[0], np.cumsum(kept)])
            edge = np.concatenate([[0], ends])
            for i in range(chunk.documents):
                a, b = upto[chunk.offsets[i]], upto[chunk.offsets[i + 1]]
                words = chunk.offsets[i + 1] - chunk.offsets[i]
                n.append(words)
                gone.append(words - (b - a))
                sha.append(hashlib.sha256(data[edge[a]: max(edge[a], edge[b] - 1)]).hexdigest())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string())],
            ["doc_id", "n_words", "n_removed", "kept_sha256"],
        )


def dedup_substrings(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Per document the number of words, of removed words, and the digest of the kept ones."""
    keyed = tk.document_key(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    return apply_spans(
        keyed, substring_spans(keyed, length), _digests,
        "doc_id long, n_words long, n_removed long, kept_sha256 string",
    )


def kept_texts(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``docs`` with repeated windows cut out of their texts. All rows and columns stay."""
    from noticelake.llm.suffixes import _cut

    keyed = tk.document_key(docs)
    return apply_spans(keyed, substring_spans(keyed, length), _cut, docs.schema)
