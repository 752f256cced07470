"""Repeated passages across a corpus, from anchored runs of windows.

A window is ``length`` consecutive words of one document. A front end (sparse suffix positions,
or symbols of a locally consistent parse) gives every window an anchor that depends on the
window's words alone. Neighbouring windows with one anchor form a run, so a corpus has far fewer
runs than windows, and equal windows always share the anchor's name.

1. Names of anchors are counted with partial sums; a bitmap of the repeated ones prunes the rest.
2. Adjacent remaining runs form groups, which end at names of a certain kind. Groups with the same
   words are repeats as a whole, but for the first; only first groups are taken apart again.
   Their runs are collapsed by content: one row per different run, with its first place and its
   count. Copies, however many, leave one row per task before either shuffle.
3. Different runs are sorted by (name, content), cut by range, and compared with their neighbours:
   only names with two different runs, and the rows at the edges of a range, need a closer look.
4. Copies of a run after its first place are repeats as a whole. Where a name has different runs,
   their first places are extended left and right to single windows, which are compared by
   two 64-bit hashes of all their words.

No step emits pairs, and no group is gathered in one task. Runs with very many copies are looked up in a
bounded table that every task holds, and adjacent ones leave it as one row; other joins on hot keys are plain
shuffle joins, which Spark cuts where they are skewed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from noticelake.llm import tokens as tk
from noticelake.llm.bitmaps import bitmap_of, maybe_in
from noticelake.session import scratch_path

#: (word hashes, window starts, length) -> (number of the anchor's place, name of the anchor)
Anchors = Callable[[np.ndarray, np.ndarray, int], tuple[np.ndarray, np.ndarray]]

GROUPS = "g long, k long, s int, n int, as array<long>, cs array<long>, ss array<int>, ns array<int>"
#: One name in so many ends a group of runs. A passage of 50 to 100 words has about a dozen runs, and
#: those at its ends differ from copy to copy, so groups must be short to lie inside it.
GROUP = 4

#: A run with so many copies is looked up inside the tasks instead of joined, at most so many different ones;
#: any others are joined.
COMMON, MOST_COMMON = 1_000, 100_000


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: lineage ends here."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def window_starts(chunk: tk.Chunk, length: int) -> np.ndarray:
    ends = np.repeat(chunk.offsets[1:], np.diff(chunk.offsets))
    return np.flatnonzero(np.arange(len(ends)) + length <= ends)


def _runs(chunk: tk.Chunk, length: int, anchors: Anchors):
    """First window, number of windows and anchor name of each run of a chunk."""
    starts = window_starts(chunk, length)
    if not len(starts):
        return None
    place, name = anchors(chunk.hashes, starts, length)
    new = np.ones(len(starts), bool)
    new[1:] = (place[1:] != place[:-1]) | (starts[1:] != starts[:-1] + 1)
    at = np.flatnonzero(new)
    return starts[at], np.diff(np.append(at, len(starts))), name[at]


def _names(length: int, anchors: Anchors):
    @tk.tidy
    def emit(batches: Iterator[pa.RecordBatch]):
        with np.errstate(over="ignore"):
            for batch in batches:
                for chunk in tk.chunks(batch.column("text")):
                    if (runs := _runs(chunk, length, anchors)) is not None:
                        yield pa.RecordBatch.from_arrays([pa.array(runs[2].view(np.int64))], ["a"])

    return emit


def _lists(values: np.ndarray, offsets: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values))


def _rows(length: int, anchors: Anchors, repeated):
    """Groups of adjacent runs; a group ends where a name says so, whatever stands around it."""

    @tk.tidy
    def emit(batches: Iterator[pa.RecordBatch]):
        bitmap = repeated.value
        with np.errstate(over="ignore"):
            for batch in batches:
                keys = batch.column("_key").to_numpy()
                for chunk in tk.chunks(batch.column("text")):
                    if (runs := _runs(chunk, length, anchors)) is None:
                        continue
                    keep = maybe_in(bitmap, runs[2])
                    starts, n, name = (x[keep] for x in runs)
                    if not len(starts):
                        continue
                    prefix = tk.WORDS.prefix(chunk.hashes)

                    def content(first, count, prefix=prefix):
                        found = tk.WORDS.of(prefix, first, first + count - 1 + length)
                        return tk.mix(found + count.astype(np.uint64)).view(np.int64)

                    new = name & np.uint64(GROUP - 1) == 0
                    new[0] = True
                    new[1:] |= starts[1:] != starts[:-1] + n[:-1]
                    at = np.flatnonzero(new)
                    upto = np.append(at, len(starts))
                    first, last = starts[at], upto[1:] - 1
                    total = starts[last] + n[last] - first
                    document = np.searchsorted(chunk.offsets, first, "right") - 1
                    here = chunk.offsets[document]
                    yield pa.RecordBatch.from_arrays([
                        pa.array(content(first, total)), pa.array(keys[chunk.first + document]),
                        pa.array((first - here).astype(np.int32)), pa.array(total.astype(np.int32)),
                        _lists(name.view(np.int64), upto), _lists(content(starts, n), upto),
                        _lists((starts - np.repeat(here, np.diff(upto))).astype(np.int32), upto),
                        _lists(n.astype(np.int32), upto),
                    ], ["g", "k", "s", "n", "as", "cs", "ss", "ns"])

    return emit


@tk.tidy
def _compare_neighbours(batches: Iterator[pa.RecordBatch]):
    """Mark runs whose neighbour in the order has the same name; rows at an edge count as such."""
    last = None  # the batch before, whose last row waits for its right neighbour
    for batch in batches:
        if not batch.num_rows:
            continue
        if last is not None:
            yield _marked(last[0], last[1], batch.column("a")[0].as_py())
            last = (batch, last[0].column("a")[-1].as_py())
        else:
            last = (batch, None)
    if last is not None:
        yield _marked(*last, None)


def _marked(batch: pa.RecordBatch, before: int | None, after: int | None) -> pa.RecordBatch:
    a = batch.column("a").to_numpy()
    left, right = np.empty(len(a), bool), np.empty(len(a), bool)
    left[1:] = right[:-1] = a[1:] == a[:-1]
    left[0] = before is None or before == a[0]
    right[-1] = after is None or after == a[-1]
    mixed = pa.array(left | right)
    return pa.RecordBatch.from_arrays([*batch.columns, mixed], [*batch.schema.names, "mixed"])


def _windows(length: int, places: bool = False):
    """Two hashes of every window of the runs listed with each text; with ``places`` also the
    starts of its run and of its group."""

    @tk.tidy
    def emit(batches: Iterator[pa.RecordBatch]):
        with np.errstate(over="ignore"):
            for batch in batches:
                keys = batch.column("_key").to_numpy()
                lists = batch.column("runs")
                for chunk in tk.chunks(batch.column("text")):
                    part = lists.slice(chunk.first, chunk.documents)
                    runs = part.flatten()
                    if not len(runs):
                        continue
                    count = np.diff(part.offsets.to_numpy())
                    document = np.repeat(np.arange(chunk.documents), count)
                    s, n = runs.field("s").to_numpy(), runs.field("n").to_numpy()
                    document = np.repeat(document, n)
                    r, s = np.repeat(s, n), np.repeat(s, n) + (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
                    at = s + chunk.offsets[document]
                    ok = at + length <= chunk.offsets[document + 1]  # rows that share an id
                    more = [r[ok], np.repeat(runs.field("q").to_numpy(), n)[ok]] if places else []
                    at, document, s = at[ok], document[ok], s[ok]
                    one = tk.WORDS.of(tk.WORDS.prefix(chunk.hashes), at, at + length)
                    two = tk.WORDS_2.prefix(tk.mix(chunk.hashes ^ np.uint64(0x5851F42D4C957F2D)))
                    two = tk.WORDS_2.of(two, at, at + length)
                    yield pa.RecordBatch.from_arrays([
                        pa.array(one.view(np.int64)), pa.array(two.view(np.int64)),
                        pa.array(keys[chunk.first + document]), pa.array(s.astype(np.int32)),
                        *(pa.array(x.astype(np.int32)) for x in more),
                    ], ["w", "v", "k", "s", *(["r", "q"] if places else [])])

    return emit


def _having(bitmap, wanted: bool = True):
    @tk.tidy
    def emit(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            found = maybe_in(bitmap.value, batch.column("_key").to_numpy())
            yield batch.filter(pa.array(found == wanted))

    return emit


def _slots(a: np.ndarray, c: np.ndarray, n: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return tk.mix(a.view(np.uint64) ^ tk.mix(c.view(np.uint64) + n.astype(np.uint64)))


def _common(marked: DataFrame, least: int, most: int) -> dict[str, np.ndarray]:
    """First places of the runs with the most copies, sorted by a hash of their name; one run per hash."""
    found = marked.filter(F.col("copies") >= least).orderBy(F.desc("copies")).limit(most).select(
        "a", "c", "n", F.col("k").alias("source"), F.col("s").alias("at")).toArrow()
    table = {name: found[name].to_numpy() for name in found.column_names}
    table["slot"], first = np.unique(_slots(table["a"], table["c"], table["n"]), return_index=True)
    return {name: x if name == "slot" else x[first] for name, x in table.items()}


def _listed(known: dict[str, np.ndarray], batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Places in the table, and whether the runs of a batch are really there."""
    a, c, n = (batch.column(x).to_numpy() for x in ("a", "c", "n"))
    at = np.minimum(np.searchsorted(known["slot"], _slots(a, c, n)), len(known["slot"]) - 1)
    return at, (known["a"][at] == a) & (known["c"][at] == c) & (known["n"][at] == n)


def _not_listed(table):
    @tk.tidy
    def emit(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            yield batch.filter(pa.array(~_listed(table.value, batch)[1]))

    return emit


def _looked_up(table):
    """Stretches of the runs that the table lists, but for their first places.

    Runs of a group come side by side in document order, so adjacent copies with one source make one row."""

    @tk.tidy
    def emit(batches: Iterator[pa.RecordBatch]):
        known = table.value
        for batch in batches:
            at, listed = _listed(known, batch)
            k, s, n = (batch.column(x).to_numpy() for x in ("k", "s", "n"))
            source = known["source"][at]
            copy = listed & ((source != k) | (known["at"][at] != s))
            k, s, n, source = k[copy], s[copy], n[copy], source[copy]
            if not len(k):
                continue
            new = np.ones(len(k), bool)
            new[1:] = (k[1:] != k[:-1]) | (s[1:] != s[:-1] + n[:-1]) | (source[1:] != source[:-1])
            first = np.flatnonzero(new)
            total = np.add.reduceat(n, first).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(k[first]), pa.array(s[first]), pa.array(total), pa.array(source[first])],
                ["k", "s", "n", "source"])

    return emit


def repeated_runs(docs: DataFrame, length: int, anchors: Anchors, every: bool = False,
                  common: int = COMMON, most_common: int = MOST_COMMON) -> DataFrame:
    """Runs of windows whose words also start earlier in the corpus.

    ``docs`` has ``_key`` and ``text``. Earlier means a smaller key, or the same key and an
    earlier start. Returns ``k`` (key), ``s`` (first window), ``n`` (windows), ``source`` (key of
    an earlier document with these words). With ``every`` also ``over``: stretches of windows
    (``o`` from ``s`` on, ``n``) that stand still earlier, and where. A copied group points to
    its first place, whose runs may be copies, and their first places may hold repeated windows;
    so the smallest source of all that lists a window is the first document that has it. Without
    ``every``, copies of at most ``most_common`` runs that have ``common`` or more are looked up inside
    the tasks, and a row may stand for several adjacent runs.
    """
    place = ["q"] if every else []
    spark = docs.sparkSession
    tk.bound_batches(spark)
    docs = docs.select("_key", "text")
    names = docs.mapInArrow(_names(length, anchors), "a long").groupBy("a").count()
    repeated = spark.sparkContext.broadcast(bitmap_of(names.filter("count > 1"), "a"))
    groups = stored(docs.mapInArrow(_rows(length, anchors, repeated), GROUPS), "groups")
    repeated.destroy()
    heads = groups.groupBy("g", "n").agg(F.min(F.struct("k", "s")).alias("f"), F.count("*").alias("copies"))
    heads = stored(heads.filter("copies > 1").select("g", "n", F.col("f.k").alias("source"), F.col("f.s").alias("at")),
                   "heads")
    other = (F.col("k") != F.col("source")) | (F.col("s") != F.col("at"))
    whole = groups.select("g", "k", "s", "n").join(heads, ["g", "n"]).filter(other).select("k", "s", "n", "source")
    firsts_only = groups.join(heads, ["g", "n"], "left").filter(F.col("source").isNull() | ~other)
    members = F.arrays_zip(*(F.col(c) for c in ("as", "cs", "ss", "ns")))
    runs = stored(firsts_only.select("k", F.col("s").alias("q"), F.inline(members)).select(
        F.col("as").alias("a"), F.col("cs").alias("c"), "k", F.col("ss").alias("s"), F.col("ns").alias("n"), *place),
        "runs")

    different = runs.groupBy("a", "c", "n").agg(
        F.min(F.struct("k", "s", *place)).alias("f"), F.count("*").alias("copies")
    ).select("a", "c", "n", F.col("f.k").alias("k"), F.col("f.s").alias("s"), *(f"f.{x}" for x in place), "copies")
    schema = StructType([*different.schema, StructField("mixed", BooleanType())])
    ordered = different.repartitionByRange("a", "c").sortWithinPartitions("a", "c")
    marked = stored(
        ordered.mapInArrow(_compare_neighbours, schema).filter("mixed OR copies > 1"), "marked"
    )

    first = marked.filter("copies > 1").select(
        "a", "c", "n", F.col("k").alias("source"), F.col("s").alias("at")
    )
    shape, looked_up = ["k", "s", "n", "source"], None
    if not every and len((table := _common(marked, common, most_common))["slot"]):
        table = spark.sparkContext.broadcast(table)
        looked_up = runs.mapInArrow(_looked_up(table), "k long, s int, n int, source long")
        first = first.mapInArrow(_not_listed(table), first.schema)
    copies = runs.join(first, ["a", "c", "n"]).filter(other)

    closer = marked.filter("mixed").select("k", "s", "n", *place)
    wanted = spark.sparkContext.broadcast(bitmap_of(closer, "k"))
    closer = closer.groupBy(F.col("k").alias("_key")).agg(
        F.collect_list(F.struct("s", "n", *place)).alias("runs")
    )
    texts = docs.mapInArrow(_having(wanted), docs.schema)
    windows = stored(
        texts.join(closer, "_key").mapInArrow(
            _windows(length, every), "w long, v long, k long, s int" + (", r int, q int" if every else "")),
        "windows",
    )
    wanted.destroy()
    firsts = windows.groupBy("w", "v").agg(
        F.min(F.struct("k", "s")).alias("f"), F.count("*").alias("times")
    ).filter("times > 1")
    edges = windows.join(firsts, ["w", "v"]).filter(F.struct("k", "s") != F.col("f")).select(
        "k", "s", F.lit(1).alias("n"), F.col("f.k").alias("source"), *(["r", "q"] if every else [])
    )
    if not every:
        found = whole.unionByName(copies.select(shape)).unionByName(edges)
        return found if looked_up is None else found.unionByName(looked_up)

    edges = stored(edges, "edges")
    within = edges.groupBy(F.col("k").alias("source"), F.col("r").alias("at")).agg(F.collect_list(F.struct(
        (F.col("s") - F.col("r")).alias("o"), "n", F.col("source").alias("d"))).alias("over"))
    copies = stored(copies.join(within, ["source", "at"], "left").select(*shape, "q", "over"), "copies")
    offset = (F.col("s") - F.col("q")).alias("o")
    inner = copies.select("k", "q", offset, F.explode("over").alias("x")).select(
        "k", "q", (F.col("o") + F.col("x.o")).alias("o"), "x.n", F.col("x.d").alias("d"))
    listed = inner.unionByName(copies.select("k", "q", offset, "n", F.col("source").alias("d"))).unionByName(
        edges.select("k", "q", offset, "n", F.col("source").alias("d")))
    places = heads.select(F.col("source").alias("k"), F.col("at").alias("q")).distinct()
    listed = listed.join(places, ["k", "q"]).groupBy(F.col("k").alias("source"), F.col("q").alias("at")).agg(
        F.collect_list(F.struct("o", "n", "d")).alias("over"))
    whole = groups.select("g", "k", "s", "n").join(heads, ["g", "n"]).filter(other).join(
        listed, ["source", "at"], "left").select(*shape, "over")
    none = F.lit(None).cast(whole.schema["over"].dataType).alias("over")
    return whole.unionByName(copies.select(*shape, "over")).unionByName(edges.select(*shape, none))


def word_spans(runs: DataFrame, length: int) -> DataFrame:
    """Per key the sorted, merged stretches of words [b, e) that the runs cover.

    One document's stretches come together in one row; their number is bounded by its length.
    """
    spans = runs.groupBy(F.col("k").alias("_key")).agg(F.sort_array(F.collect_set(F.struct(
        F.col("s").alias("b"), (F.col("s") + F.col("n") - 1 + length).alias("e"))
    )).alias("_spans"))
    return spans.mapInArrow(_merged, "_key long, _spans array<struct<b:int,e:int>>")


def apply_spans(docs: DataFrame, spans: DataFrame, function, schema) -> DataFrame:
    """``function`` over Arrow batches of ``docs`` (with _key) and the ``spans`` of each row.

    Spans are null where there are none. Only documents that may have spans are shuffled to them.
    """
    spans = stored(spans, "spans")
    found = docs.sparkSession.sparkContext.broadcast(bitmap_of(spans, "_key"))

    def without(batches: Iterator[pa.RecordBatch]):
        def filled():
            for batch in _having(found, False)(batches):
                none = pa.nulls(batch.num_rows, _SPANS)
                yield pa.RecordBatch.from_arrays([*batch.columns, none], [*batch.schema.names, "_spans"])

        return function(filled())

    some = docs.mapInArrow(_having(found), docs.schema).join(spans, "_key", "left")
    return some.mapInArrow(function, schema).unionByName(docs.mapInArrow(without, schema))


_SPANS = pa.list_(pa.struct([("b", pa.int32()), ("e", pa.int32())]))


@tk.tidy
def _merged(batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        lists = batch.column("_spans")
        flat, count = lists.flatten(), np.diff(lists.offsets.to_numpy())
        if not len(flat):
            continue
        document = np.repeat(np.arange(len(count)), count)
        # Documents one after another on one line, so that one running maximum serves all.
        far = int(flat.field("e").to_numpy().max()) + 2
        b, e = (flat.field(x).to_numpy().astype(np.int64) + document * far for x in ("b", "e"))
        reach = np.maximum.accumulate(e)
        new = np.ones(len(b), bool)
        new[1:] = b[1:] > reach[:-1]
        at = np.flatnonzero(new)
        owner = document[at]
        b, e = b[at] - owner * far, reach[np.append(at[1:], len(b)) - 1] - owner * far
        offsets = np.searchsorted(owner, np.arange(len(count) + 1)).astype(np.int32)
        merged = pa.StructArray.from_arrays(
            [pa.array(b.astype(np.int32)), pa.array(e.astype(np.int32))], ["b", "e"]
        )
        yield pa.RecordBatch.from_arrays(
            [batch.column("_key"), pa.ListArray.from_arrays(pa.array(offsets), merged).cast(_SPANS)],
            ["_key", "_spans"],
        )


def kept_words(chunk: tk.Chunk, part: pa.ListArray) -> np.ndarray:
    """Which words of a chunk lie outside the stretches listed with its documents."""
    step = np.zeros(len(chunk.hashes) + 1, np.int64)
    flat = part.flatten()
    if len(flat):
        count = np.diff(part.offsets.to_numpy())
        document = np.repeat(np.arange(chunk.documents), count)
        end = chunk.offsets[document + 1]
        b = np.minimum(flat.field("b").to_numpy() + chunk.offsets[document], end)
        e = np.minimum(flat.field("e").to_numpy() + chunk.offsets[document], end)
        np.add.at(step, b, 1)
        np.add.at(step, e, -1)
    return np.cumsum(step[:-1]) == 0
