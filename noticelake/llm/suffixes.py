"""Suffix-array dedup over sparse suffixes (operator 3).

Of all suffixes of all documents only those that start at a minimiser are retained: in every
window of ``length`` words, the stretch of ``SEED`` words with the smallest hash (the leftmost on
a tie). A passage of at least ``length`` words contains a retained position in each of its
copies. Retained positions, each with the run of windows that chose it, are sorted by the hashes of
their seed and of the run's words and compared with their neighbours; runs that differ under one seed
are compared window by window, which gives the exact words that a repeated window covers. The order is
one of hashes, not of words: equal runs are neighbours in it, longer common beginnings are not.

Defined results: null and empty texts have no windows; texts are taken whole at any length; ties
are settled by the smallest document, then the earliest start; rows with one doc_id are one
document, rows without one are known by their text; an empty table gives an empty result; extra
columns pass through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticelake.llm import tokens as tk
from noticelake.llm.repeats import apply_spans, kept_words, repeated_runs, word_spans

LENGTH = 50
SEED = 8
_PLACE_BITS = 28


def minimisers(hashes: np.ndarray, starts: np.ndarray, length: int, seed: int = SEED):
    """For each window the place and the name of its retained suffix."""
    seed = min(seed, length)
    n = len(hashes) - seed + 1
    at = np.arange(n)
    names = tk.WORDS.of(tk.WORDS.prefix(hashes), at, at + seed)
    # The hash in the high bits and the place in the low ones: a minimum is leftmost on a tie.
    low = np.uint64((1 << _PLACE_BITS) - 1)
    best = (tk.mix(names) & ~low) | at.astype(np.uint64)
    width, span = length - seed + 1, 1
    while 2 * span <= width:
        best = np.minimum(best[:-span], best[span:])
        span *= 2
    found = np.minimum(best[starts], best[starts + width - span])
    place = (found & low).astype(np.int64)
    return place, names[place]


def _sourced(length: int):
    """Merged stretches of each document, and per stretch the sources of its windows."""

    @tk.tidy
    def emit(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            lists = batch.column("_links")
            flat, count = lists.flatten(), np.diff(lists.offsets.to_numpy())
            if not len(flat):
                continue
            document = np.repeat(np.arange(len(count)), count)
            s, n, source = (flat.field(c).to_numpy() for c in ("s", "n", "source"))
            over = flat.field("over").fill_null([])
            owner = np.repeat(np.arange(len(s)), np.diff(over.offsets.to_numpy()))
            over = over.flatten()
            document = np.concatenate([document, document[owner]])
            s = np.concatenate([s, s[owner] + over.field("o").to_numpy()]).astype(np.int64)
            n = np.concatenate([n, over.field("n").to_numpy()])
            source = np.concatenate([source, over.field("d").to_numpy()])
            # Documents one after another on one line; of each window the smallest source.
            far = int((s + n).max()) + length + 1
            at = np.repeat(s + document * far, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            source = np.repeat(source, n)
            order = np.lexsort((source, at))
            at, source = at[order], source[order]
            first = np.append(True, at[1:] != at[:-1])
            at, source = at[first], source[first]
            piece = np.flatnonzero(np.append(True, (at[1:] != at[:-1] + 1) | (source[1:] != source[:-1])))
            last = at[np.append(piece[1:], len(at)) - 1]
            document, begin, source = at[piece] // far, at[piece], source[piece]
            new = np.flatnonzero(np.append(True, begin[1:] > last[:-1] + length))
            document, here = document[new], document * far
            b, e = begin - here, last + length - here
            pieces = pa.StructArray.from_arrays([pa.array(b), pa.array(e), pa.array(source)], ["start", "end", "doc_id"])
            upto = np.append(new, len(begin))
            yield pa.RecordBatch.from_arrays([
                batch.column("_key").take(pa.array(document)), pa.array(b[new]), pa.array(e[upto[1:] - 1]),
                pa.array(np.minimum.reduceat(source, new)),
                pa.ListArray.from_arrays(pa.array(upto.astype(np.int32)), pieces),
            ], ["doc_id", "start", "end", "first_doc_id", "sources"])

    return emit


def repeated_spans(docs: DataFrame, length: int = LENGTH, doc_id: str = "doc_id",
                   text: str = "text") -> DataFrame:
    """Words [start, end) of each document that repeat ``length`` or more words found earlier.

    ``sources`` cuts a stretch by the first document that has each window of it (the document
    itself for repeats within it); ``first_doc_id`` is the smallest of them.
    """
    keyed = tk.document_key(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")))
    runs = repeated_runs(keyed, length, minimisers, every=True)
    links = runs.groupBy(F.col("k").alias("_key")).agg(
        F.collect_list(F.struct("s", "n", "source", "over")).alias("_links"))
    return links.mapInArrow(_sourced(length), "doc_id long, start long, end long, first_doc_id long, "
                            "sources array<struct<start:long,end:long,doc_id:long>>")


@tk.tidy
def _cut(batches: Iterator[pa.RecordBatch]):
    """Texts without the listed words. What stood between kept words stays as it was."""
    for batch in batches:
        texts, out = batch.column("text"), []
        for chunk in tk.chunks(texts):
            part = batch.column("_spans").slice(chunk.first, chunk.documents)
            kept = kept_words(chunk, part)
            for i in range(chunk.documents):
                a, b = chunk.offsets[i], chunk.offsets[i + 1]
                if kept[a:b].all():
                    out.append(texts[chunk.first + i].as_py())
                    continue
                edge = np.flatnonzero(np.diff(np.concatenate([[False], kept[a:b], [False]]).astype(np.int8)))
                pieces = [
                    chunk.data[chunk.starts[a + x]: chunk.ends[a + y - 1]].tobytes()
                    for x, y in zip(edge[::2], edge[1::2], strict=True)
                ]
                out.append(b"\n".join(pieces).decode())
        columns = [pa.array(out, pa.string()) if n == "text" else c
                   for n, c in zip(batch.schema.names, batch.columns, strict=True) if n not in ("_key", "_spans")]
        names = [n for n in batch.schema.names if n not in ("_key", "_spans")]
        yield pa.RecordBatch.from_arrays(columns, names)


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``docs`` with repeated passages cut out of their texts. All rows stay."""
    plain, named = tk.plain_names(docs)
    keyed = tk.document_key(plain)
    spans = word_spans(repeated_runs(keyed, length, minimisers), length)
    return named(apply_spans(keyed, spans, _cut, plain.schema))
