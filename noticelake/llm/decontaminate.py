"""Benchmark decontamination by spaced-seed hashing (operator 2).

Tokens are runs of letters and digits, lower-cased in ASCII. A window of ``WINDOW`` tokens is cut
into four blocks, and each of six fixed masks keeps two of them and ignores the others, so two
windows that differ in at most ``SUBSTITUTIONS`` tokens agree under at least one mask. Hashes of
the kept tokens of all test windows are joined with those of all training windows; each hit is
verified token by token. Equal test windows are searched once; their hits are joined with all places
(item_id, offset) of the window, and windows on one diagonal are merged into one overlap.

The test side is read in blocks of ``BLOCK`` different windows, each sent to the tasks (a bound
of about 100 MB), and every block meets all training texts; training texts are never shuffled. The
hits of a block are written before the next block is made, so one block is held at a time, and
overlaps are merged over the hits of all blocks.

Defined results: null and empty texts have no windows; texts are taken whole; test items shorter
than a window must occur whole and unchanged; items with fewer than ``SHORTEST`` tokens match
nothing; every item that has a window is named, items without an item_id as one; repeated rows
are each reported; empty tables give empty results; extra columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from noticelake.llm import tokens as tk
from noticelake.llm.bitmaps import maybe_in
from noticelake.llm.repeats import stored

WINDOW = 12
SUBSTITUTIONS = 2
SHORTEST = 5
BLOCK = 400_000
_U = np.uint64
_SIDE = WINDOW // 4
#: The token positions that each mask keeps.
MASKS = [np.r_[a * _SIDE: (a + 1) * _SIDE, b * _SIDE: (b + 1) * _SIDE]
         for a, b in combinations(range(4), 2)]
_FACTORS = np.random.default_rng(7).integers(1, 1 << 63, WINDOW, dtype=np.uint64) * _U(2) + _U(1)
_SEED_BITS = 23


def masked(hashes: np.ndarray, at: np.ndarray, positions, tag: int) -> np.ndarray:
    """Hash of the tokens at the kept positions of each window."""
    total = np.full(len(at), _U(tag))
    for j in positions:
        total += hashes[at + j] * _FACTORS[j]
    return tk.mix(total)


@tk.tidy
def _test_windows(batches: Iterator[pa.RecordBatch]):
    with np.errstate(over="ignore"):
        for batch in batches:
            items = batch.column("item_id")
            for chunk in tk.chunks(batch.column("text"), tk.NOT_ALNUM, tk.LOWER):
                count = np.diff(chunk.offsets)
                width = np.minimum(count, WINDOW)
                per = np.where(width >= SHORTEST, count - width + 1, 0)
                item = np.repeat(np.arange(chunk.documents), per)
                offset = np.arange(len(item)) - np.repeat(np.cumsum(per) - per, per)
                at, width = chunk.offsets[item] + offset, width[item]
                span = np.arange(WINDOW)
                inside = span < width[:, None]
                rows = chunk.hashes[np.minimum(at[:, None] + span, max(0, len(chunk.hashes) - 1))]
                rows = np.where(inside, rows, 0) if len(rows) else np.zeros((0, WINDOW), _U)
                values = pa.array(rows.view(np.int64).ravel())
                yield pa.RecordBatch.from_arrays([
                    items.take(pa.array(chunk.first + item)), pa.array(offset.astype(np.int32)),
                    pa.array(width.astype(np.int32)),
                    pa.ListArray.from_arrays(
                        pa.array((np.arange(len(rows) + 1) * WINDOW).astype(np.int32)), values),
                ], ["item_id", "offset", "width", "tokens"])


class TestBlock:
    """Sorted seeds of one block of test windows, and the windows themselves."""

    def __init__(self, table: pa.Table):
        table = table.combine_chunks()
        n = table.num_rows
        self.window = table["window"].to_numpy()
        self.width = table["width"].to_numpy()
        flat = table["tokens"].combine_chunks().flatten().to_numpy() if n else np.zeros(0, np.int64)
        self.tokens = flat.view(_U).reshape(n, WINDOW)
        self.seeds = []  # (positions, tag, width, sorted seeds, window of each, bitmap)
        with np.errstate(over="ignore"):
            for width in np.unique(self.width):
                rows = np.flatnonzero(self.width == width)
                masks = MASKS if width == WINDOW else [np.arange(width)]
                for tag, positions in enumerate(masks):
                    flat = self.tokens[rows].ravel()
                    seeds = masked(flat, np.arange(len(rows)) * WINDOW, positions, tag)
                    order = np.argsort(seeds)
                    bitmap = np.zeros(1 << _SEED_BITS - 6, _U)
                    slots = seeds & _U((1 << _SEED_BITS) - 1)
                    np.bitwise_or.at(bitmap, (slots >> _U(6)).astype(np.int64), _U(1) << (slots & _U(63)))
                    self.seeds.append((positions, tag, int(width), seeds[order], rows[order], bitmap))

    def verified(self, chunk: tk.Chunk):
        """(document, first token, test window) of every window that passes the comparison."""
        found = []
        for positions, tag, width, seeds, rows, bitmap in self.seeds:
            ends = np.repeat(chunk.offsets[1:], np.diff(chunk.offsets))
            at = np.flatnonzero(np.arange(len(ends)) + width <= ends)
            mine = masked(chunk.hashes, at, positions, tag)
            near = maybe_in(bitmap, mine)
            at, mine = at[near], mine[near]
            low, high = np.searchsorted(seeds, mine), np.searchsorted(seeds, mine, "right")
            n = high - low
            at, rows_at = np.repeat(at, n), np.repeat(low, n)
            window = rows[rows_at + np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)]
            span = np.arange(width)
            same = (chunk.hashes[at[:, None] + span] == self.tokens[window][:, :width]).sum(axis=1)
            ok = same >= width - (SUBSTITUTIONS if width == WINDOW else 0)
            found.append(np.stack([at[ok], window[ok]]))
        at, window = np.unique(np.concatenate(found, axis=1), axis=1) if found else np.zeros((2, 0), int)
        return np.searchsorted(chunk.offsets, at, "right") - 1, at, window


def test_windows(benchmark: DataFrame, item_id: str = "item_id", text: str = "text"):
    """Different test windows with a number each, all their places, and the number of blocks."""
    tk.bound_batches(benchmark.sparkSession)
    rows = benchmark.select(F.col(item_id).cast("long").alias("item_id"), F.col(text).alias("text"))
    rows = stored(rows.mapInArrow(
        _test_windows, "item_id long, offset int, width int, tokens array<long>").distinct(), "test-places")
    windows = stored(rows.select("width", "tokens").distinct().withColumn(
        "window", F.monotonically_increasing_id()), "test-windows")
    places = rows.join(windows, ["width", "tokens"]).select("window", "item_id", "offset", "width")
    return windows, places, max(1, -(-windows.count() // BLOCK))


def _block(windows: DataFrame, blocks: int, i: int):
    mine = F.pmod(F.xxhash64("tokens"), F.lit(blocks)) == i
    return windows.sparkSession.sparkContext.broadcast(
        TestBlock(windows.filter(mine).orderBy("window").toArrow()))


def _hits(block):
    @tk.tidy
    def emit(batches: Iterator[pa.RecordBatch]):
        test = block.value
        with np.errstate(over="ignore"):
            for batch in batches:
                for chunk in tk.chunks(batch.column("text"), tk.NOT_ALNUM, tk.LOWER):
                    document, at, window = test.verified(chunk)
                    if not len(at):
                        continue
                    row = pa.array(chunk.first + document)
                    yield pa.RecordBatch.from_arrays([
                        batch.column("doc_id").take(row), batch.column("digest").take(row),
                        pa.array((at - chunk.offsets[document]).astype(np.int64)),
                        pa.array(test.window[window].astype(np.int64)),
                    ], ["doc_id", "digest", "at", "window"])

    return emit


def overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Token stretches [start, end) of documents that match a test item from ``item_start`` on."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("digest"), "text")
    windows, places, blocks = test_windows(benchmark)
    found = None
    for i in range(blocks):
        block = _block(windows, blocks, i)
        hits = stored(texts.mapInArrow(_hits(block), "doc_id long, digest long, at long, window long"), "hits")
        block.destroy()
        found = hits if found is None else found.unionByName(hits)
    # A row has a window at a place once, so the count is the number of equal rows.
    found = found.groupBy("doc_id", "digest", "at", "window").agg(F.count("*").alias("rows")).join(places, "window")
    line = Window.partitionBy("doc_id", "digest", "rows", "item_id", "width", "diagonal").orderBy("at")
    found = found.withColumn("diagonal", F.col("at") - F.col("offset"))
    new = F.coalesce(F.col("at") > F.lag("at").over(line) + F.col("width"), F.lit(True)).cast("long")
    found = found.withColumn("new", new).withColumn("n", F.sum("new").over(line))
    found = found.groupBy("doc_id", "digest", "rows", "item_id", "width", "diagonal", "n").agg(
        F.min("at").alias("start"), (F.max("at") + F.col("width")).alias("end"))
    return found.withColumn("row", F.explode(F.sequence(F.lit(1), "rows"))).select(
        "doc_id", "item_id", "start", "end", (F.col("start") - F.col("diagonal")).alias("item_start")
    ).orderBy("doc_id", "item_id", "start", "item_start")


def _clean(block):
    @tk.tidy
    def emit(batches: Iterator[pa.RecordBatch]):
        with np.errstate(over="ignore"):
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                for chunk in tk.chunks(batch.column("text"), tk.NOT_ALNUM, tk.LOWER):
                    document, _, _ = block.value.verified(chunk)
                    keep[chunk.first + document] = False
                yield batch.filter(pa.array(keep))

    return emit


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the documents that overlap a test item. No shuffle."""
    windows, _, blocks = test_windows(benchmark)
    for i in range(blocks):
        block = _block(windows, blocks, i)
        docs = docs.mapInArrow(_clean(block), docs.schema)
        if i + 1 < blocks:
            docs = stored(docs, "clean")
            block.destroy()
    return docs
