"""Hard negatives from embeddings over Hilbert-ordered blocks with zone maps (operator 13).

Vectors become whole numbers, ``floor(SCALE * x)``, so scores are exact inner products and ties are
real. Rows are ordered along a Hilbert curve through the dimensions that vary most, label by label,
and written as Parquet blocks of at most ``BLOCK`` rows with the smallest and largest value of every
dimension. For an anchor, interval arithmetic over these bounds every score in a block, so a block
is read only if some score may fall into one of the anchor's windows:

1. positives have one window, all scores of the same label; negatives one per positive.
2. First the block with the nearest centre, of every ``CHUNK`` blocks, is read. If that fills a
   window, its last entry becomes the window's lower end, and few other blocks remain.
3. All other blocks that may hold a better entry are read.

Anchors travel in slices to the blocks; a task holds one block and one slice at a time. Nothing but
the first entries of each window leaves a block, and of these the first of all blocks are kept. The
result is exact. Where vectors are spread evenly in many dimensions, bounds are wide and most blocks
are read: the work is then anchors times rows, in blocks.

Defined results: rows without id, label or vector, or with a null or not finite component, take no
part; of rows that repeat an id the one with the smallest label, then vector, does; missing
components of shorter vectors are 0; a scaled component beyond ``LIMIT`` counts as ``LIMIT``; ties
go to the smaller id; an anchor without positives or a window without negatives gives no row; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noticelake.llm.repeats import stored

SCALE = 256
LIMIT = 1 << 24
BLOCK = 2_048
SLICE = 512
#: Blocks whose bounds are looked at together.
CHUNK = 256
#: Dimensions of the curve, and bits of each.
CURVE, BITS = 8, 8
POSITIVES = 5
NEGATIVES = 5
_FAR = 1 << 62


def quantised(batches: Iterator[pa.RecordBatch]):
    """(id, label, embedding) -> the vector as packed numbers, for rows that take part."""
    for batch in batches:
        lists = batch.column("embedding")
        flat, count = lists.flatten(), np.diff(lists.offsets.to_numpy())
        x = flat.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
        # A null list may still span values.
        count = np.where(lists.is_null().to_numpy(zero_copy_only=False), 0, count)
        owner = np.repeat(np.arange(len(count)), count)
        whole = np.bincount(owner, ~np.isfinite(x), len(count)) == 0
        q = np.clip(np.floor(SCALE * np.where(np.isfinite(x), x, 0)), -LIMIT, LIMIT).astype("<i4")
        at = np.cumsum(count) - count
        some = np.flatnonzero(whole & lists.is_valid().to_numpy(zero_copy_only=False))
        packed = [q[at[i]: at[i] + count[i]].tobytes() for i in some]
        rows = pa.array(some)
        yield pa.RecordBatch.from_arrays(
            [batch.column("id").take(rows), batch.column("label").take(rows), pa.array(packed, pa.binary())],
            ["id", "label", "v"])


def matrix(packed: list[bytes], width: int = 0) -> np.ndarray:
    """Rows of numbers, filled up with zeros to the longest."""
    size = np.fromiter(map(len, packed), np.int64, len(packed)) // 4
    width = max(width, int(size.max(initial=0)))
    out = np.zeros((len(packed), width), np.int64)
    out[np.arange(width) < size[:, None]] = np.frombuffer(b"".join(packed), "<i4")
    return out


def hilbert(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """The place of whole points with coordinates of ``bits`` bits along the Hilbert curve.

    The coordinates are transposed to the curve's index bit plane by bit plane: planes above undo
    their reflections and exchanges, then a Gray code is resolved over all dimensions.
    """
    x = points.astype(np.uint64).T.copy()
    n = len(x)
    for bit in range(bits - 1, 0, -1):
        low = np.uint64((1 << bit) - 1)
        for i in range(n):
            up = (x[i] >> np.uint64(bit)) & np.uint64(1) == 1
            flip = np.where(up, low, np.uint64(0))
            swap = np.where(up, np.uint64(0), (x[0] ^ x[i]) & low)
            x[0] ^= flip ^ swap
            x[i] ^= swap if i else np.uint64(0)
    for i in range(1, n):
        x[i] ^= x[i - 1]
    gray = np.zeros_like(x[0])
    for bit in range(bits - 1, 0, -1):
        gray ^= np.where((x[-1] >> np.uint64(bit)) & np.uint64(1) == 1, np.uint64((1 << bit) - 1), np.uint64(0))
    x ^= gray
    out = np.zeros(x.shape[1], np.uint64)
    for bit in range(bits - 1, -1, -1):
        for i in range(n):
            out = (out << np.uint64(1)) | ((x[i] >> np.uint64(bit)) & np.uint64(1))
    return out


def _moments(batches: Iterator[pa.RecordBatch]):
    """Per dimension the sums of a task's values and squares; one row per dimension and task."""
    total, squares, n = np.zeros(0), np.zeros(0), 0
    for batch in batches:
        x = matrix(batch.column("v").to_pylist(), len(total)).astype(float)
        more = x.shape[1] - len(total)
        total, squares = (np.append(s, np.zeros(more)) for s in (total, squares))
        total, squares, n = total + x.sum(axis=0), squares + (x**2).sum(axis=0), n + len(x)
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total), pa.array(squares)], ["d", "s", "q"])


def _curve_of(axes: list[tuple[int, float, float]]):
    """Adds ``h``, the place along the curve through axes (dimension, mean, deviation)."""

    def emit(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            x = matrix(batch.column("v").to_pylist(), 1 + max((d for d, _, _ in axes), default=0))
            cells = [np.clip((x[:, d] - mean) / (6 * dev) + 0.5, 0, 0.999999) * (1 << BITS) for d, mean, dev in axes]
            h = hilbert(np.stack(cells, axis=1)) if cells else np.zeros(len(x), np.uint64)
            # Signed, in the same order.
            h = (h ^ np.uint64(1 << 63)).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(h)], [*batch.schema.names, "h"])

    return emit


def ordered(rows: DataFrame) -> DataFrame:
    """Rows (id, label, v) with their place ``h`` on the curve, in ranges along label and curve."""
    n = max(rows.count(), 1)
    moments = rows.mapInArrow(_moments, "d int, s double, q double").groupBy("d").agg(
        F.sum("s").alias("s"), F.sum("q").alias("q"))
    spread = F.sqrt(F.greatest(F.col("q") / n - (F.col("s") / n) ** 2, F.lit(0.0)))
    axes = moments.select("d", F.col("s") / n, spread.alias("dev")).filter("dev > 0").orderBy(
        F.desc("dev"), "d").limit(CURVE).collect()
    curve = _curve_of([tuple(a) for a in axes])
    return rows.mapInArrow(curve, "id long, label long, v binary, h long").repartitionByRange(
        "label", "h", "id").sortWithinPartitions("label", "h", "id")


def _pieces(batches: Iterator[pa.RecordBatch], size: int):
    """(number, label, ids, vectors) of up to ``size`` rows of one label that follow each other."""
    part = TaskContext.get().partitionId() << 32
    ids: list[int] = []
    packed: list[bytes] = []
    label, number = None, 0
    for batch in batches:
        for i, l, v in zip(*(batch.column(c).to_pylist() for c in ("id", "label", "v")), strict=True):
            if ids and (l != label or len(ids) == size):
                yield part + number, label, ids, packed
                ids, packed, number = [], [], number + 1
            label = l
            ids.append(i)
            packed.append(v)
    if ids:
        yield part + number, label, ids, packed


BLOCKS = ("block long, label long, first long, lo array<int>, hi array<int>, centre array<float>, "
          "ids array<long>, vs array<binary>")


def _blocked(size: int):
    def emit(batches: Iterator[pa.RecordBatch]):
        for number, label, ids, packed in _pieces(batches, size):
            x = matrix(packed)
            yield pa.RecordBatch.from_arrays([
                pa.array([number], pa.int64()), pa.array([label], pa.int64()), pa.array([min(ids)], pa.int64()),
                pa.array([x.min(axis=0).astype(np.int32)]), pa.array([x.max(axis=0).astype(np.int32)]),
                pa.array([x.mean(axis=0).astype(np.float32)]), pa.array([ids], pa.list_(pa.int64())),
                pa.array([packed], pa.list_(pa.binary()))],
                ["block", "label", "first", "lo", "hi", "centre", "ids", "vs"])

    return emit


def _sliced(size: int):
    def emit(batches: Iterator[pa.RecordBatch]):
        for number, label, ids, packed in _pieces(batches, size):
            yield pa.RecordBatch.from_arrays(
                [pa.array([number] * len(ids), pa.int64()), pa.array([label] * len(ids), pa.int64()),
                 pa.array(ids, pa.int64()), pa.array(packed, pa.binary())], ["slice", "label", "id", "v"])

    return emit


def _rows(arrays: list, width: int) -> np.ndarray:
    out = np.zeros((len(arrays), width))
    for i, a in enumerate(arrays):
        out[i, : len(a)] = a
    return out


def _choose(same: bool, again: bool):
    """For a slice and a chunk of bounds: the blocks to read, each with the anchors that want it.

    The first time the nearest block of the chunk; ``again`` all others that may hold an entry.
    """

    def emit(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for row in batch.to_pylist():
                zones = [z for z in row["zones"] if (z["label"] == row["label"]) == same]
                if not zones:
                    continue
                zones.sort(key=lambda z: z["block"])
                anchors = row["anchors"]
                a = matrix([x["v"] for x in anchors], max(len(z["lo"]) for z in zones)).astype(float)
                lo, hi, centre = (_rows([z[k] for z in zones], a.shape[1]) for k in ("lo", "hi", "centre"))
                up, down = np.maximum(a, 0), np.minimum(a, 0)
                most, least = up @ hi.T + down @ lo.T, up @ lo.T + down @ hi.T
                nearest = (a @ centre.T).argmax(axis=1)
                low, high, low_id = _windows(anchors)
                if again:
                    first = np.array([z["first"] for z in zones])
                    wanted = np.zeros(most.shape, bool)
                    for w in range(low.shape[1]):
                        better = (most > low[:, w, None]) | (
                            (most == low[:, w, None]) & (first[None, :] < low_id[:, w, None]))
                        wanted |= better & (least <= high[:, w, None]) & (low[:, w] <= high[:, w])[:, None]
                    wanted[np.arange(len(a)), nearest] = False
                else:
                    wanted = np.zeros(most.shape, bool)
                    wanted[np.arange(len(a)), nearest] = (low <= high).any(axis=1)
                out = [{"block": zones[z]["block"], "anchors": [anchors[i] for i in np.flatnonzero(wanted[:, z])]}
                       for z in np.flatnonzero(wanted.any(axis=0))]
                for one in out:
                    yield pa.RecordBatch.from_pylist([one], pa.schema(
                        [("block", pa.int64()), ("anchors", batch.schema.field("anchors").type)]))

    return emit


def _windows(anchors: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower ends, upper ends and ids that settle ties at lower ends, a row per anchor. Unused ones are empty."""
    most = max((len(x["windows"]) for x in anchors), default=0)
    out = np.tile(np.array([[[_FAR], [-_FAR], [0]]]), (len(anchors), 1, max(most, 1)))
    for i, x in enumerate(anchors):
        for k, w in enumerate(x["windows"]):
            out[i, :, k] = w["low"], w["high"], w["low_id"]
    return out[:, 0], out[:, 1], out[:, 2]


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products; in floating point where all sums are whole numbers there."""
    bound = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * a.shape[1]
    if bound < 1 << 24:
        return (a.astype(np.float32) @ b.astype(np.float32).T).astype(np.int64)
    if bound < 1 << 53:
        return (a.astype(float) @ b.astype(float).T).astype(np.int64)
    return a @ b.T


def _score(batches: Iterator[pa.RecordBatch]):
    """Rows sorted by block, the block itself first: the first entries of every window of every anchor."""
    block, ids, packed = None, np.zeros(0, np.int64), []
    for batch in batches:
        for row in batch.to_pylist():
            if row["vs"] is not None:
                block, ids, packed = row["block"], np.array(row["ids"]), row["vs"]
                continue
            if row["block"] != block:
                raise ValueError("a block must come before the anchors that read it")
            anchors = row["anchors"]
            a = matrix([x["v"] for x in anchors])
            b = matrix(packed, a.shape[1])
            a = np.pad(a, ((0, 0), (0, b.shape[1] - a.shape[1])))
            scores = products(a, b)
            low, high, low_id = _windows(anchors)
            own = np.array([x["id"] for x in anchors])
            inside = (scores >= low.min(axis=1)[:, None]) & (scores <= high.max(axis=1)[:, None])
            r, c = np.nonzero(inside & (ids[None, :] != own[:, None]))
            s, i = scores[r, c], ids[c]
            order = np.lexsort((i, -s, r))
            r, s, i = r[order], s[order], i[order]
            for w in range(low.shape[1]):
                ok = (s <= high[r, w]) & ((s > low[r, w]) | ((s == low[r, w]) & (i < low_id[r, w])))
                rw, sw, iw = r[ok], s[ok], i[ok]
                head = np.arange(len(rw)) - np.searchsorted(rw, rw) < max(POSITIVES, NEGATIVES)
                yield pa.RecordBatch.from_arrays([
                    pa.array(own[rw[head]]), pa.array(np.full(head.sum(), w, np.int32)), pa.array(sw[head]),
                    pa.array(iw[head])], ["anchor", "w", "score", "id"])


class Blocks:
    """The ordered blocks of a table of rows (id, label, v), and slices of its anchors."""

    def __init__(self, rows: DataFrame, anchors: Column, block: int = BLOCK, slice: int = SLICE):
        spark = rows.sparkSession
        along = ordered(rows)
        self.blocks = stored(along.mapInArrow(_blocked(block), BLOCKS), "blocks")
        self.anchors = stored(ordered(rows.filter(anchors)).mapInArrow(
            _sliced(slice), "slice long, label long, id long, v binary"), "anchors")
        self.n = self.blocks.count()
        self.chunks = max(1, -(-self.n // CHUNK))
        chunk = F.pmod(F.xxhash64("block"), F.lit(self.chunks)).alias("chunk")
        self.zones = stored(self.blocks.groupBy(chunk).agg(F.collect_list(
            F.struct("block", "label", "first", "lo", "hi", "centre")).alias("zones")), "zones")
        # Work, not bytes, decides into how many tasks blocks go.
        self.tasks = max(1, min(self.n, max(
            2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))))

    def chosen(self, windows: DataFrame, same: bool, again: bool) -> DataFrame:
        """(block, anchors): what to read for ``windows`` (id, windows)."""
        slices = self.anchors.join(windows, "id").groupBy("slice", "label").agg(
            F.collect_list(F.struct("id", "v", "windows")).alias("anchors"))
        slices = slices.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(self.chunks - 1).cast("long"))))
        schema = ("block long, anchors array<struct<id:long,v:binary,windows:array<struct<"
                  "low:long,high:long,low_id:long>>>>")
        return slices.join(self.zones, "chunk").mapInArrow(_choose(same, again), schema)

    def read(self, chosen: DataFrame) -> DataFrame:
        """(anchor, w, score, id): first entries of the windows in the chosen blocks."""
        held = self.blocks.select("block", "ids", "vs", F.lit(None).cast(chosen.schema["anchors"].dataType).alias("anchors"))
        want = chosen.select("block", F.lit(None).cast("array<long>").alias("ids"),
                             F.lit(None).cast("array<binary>").alias("vs"), "anchors")
        rows = held.unionByName(want).withColumn("kind", F.col("vs").isNull())
        return rows.repartition(self.tasks, "block").sortWithinPartitions("block", "kind").drop("kind").mapInArrow(
            _score, "anchor long, w int, score long, id long")

    def first(self, windows: DataFrame, same: bool, most: int) -> DataFrame:
        """(anchor, w, score, id, rank): the first ``most`` entries of each window."""
        by = Window.partitionBy("anchor", "w").orderBy(F.desc("score"), "id")

        def top(found: DataFrame) -> DataFrame:
            return stored(found.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= most), "first")

        near = top(self.read(self.chosen(windows, same, False)))
        last = near.filter(F.col("rank") == most).select(
            F.col("anchor").alias("id"), "w", F.col("score").alias("s"), F.col("id").alias("i"))
        raised = windows.select("id", F.posexplode("windows").alias("w", "x")).join(last, ["id", "w"], "left").select(
            "id", "w", F.struct(
                F.coalesce("s", "x.low").alias("low"), F.col("x.high").alias("high"),
                F.coalesce("i", "x.low_id").alias("low_id")).alias("x"))
        raised = raised.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("w", "x"))).alias("l")).select(
            "id", F.transform("l", lambda y: y["x"]).alias("windows"))
        return top(near.drop("rank").unionByName(self.read(self.chosen(raised, same, True))))


def _window(low: Column, high: Column) -> Column:
    return F.struct(low.cast("long").alias("low"), high.cast("long").alias("high"), F.lit(_FAR).alias("low_id"))


def mined(embeddings: DataFrame, anchors: Column, id: str = "vec_id", label: str = "label",
          vector: str = "embedding", block: int = BLOCK, slice: int = SLICE) -> DataFrame:
    """Hard negatives of the rows that ``anchors``, a condition on ``id``, names.

    An anchor's positives are its first ``POSITIVES`` other rows of the same label; for each the
    first ``NEGATIVES`` rows of other labels that score at least 0.8 of it and not more than it.
    """
    rows = embeddings.select(F.col(id).cast("long").alias("id"), F.col(label).cast("long").alias("label"),
                             F.col(vector).alias("embedding")).filter("id IS NOT NULL AND label IS NOT NULL")
    rows = stored(rows.mapInArrow(quantised, "id long, label long, v binary"), "vectors")
    if not rows.groupBy("id").count().filter("count > 1").isEmpty():
        rows = stored(rows.groupBy("id").agg(F.min(F.struct("label", "v")).alias("r")).select("id", "r.label", "r.v"), "vectors")
    held = Blocks(rows, anchors, block, slice)
    every = F.array(_window(F.lit(-_FAR), F.lit(_FAR)))
    positives = held.first(held.anchors.select("id", every.alias("windows")), True, POSITIVES).select(
        F.col("anchor").alias("anchor_id"), F.col("rank").alias("p"), F.col("id").alias("positive_id"),
        F.col("score").alias("positive_score"))
    # At least 80 of 100 parts of a whole number: less a fifth, rounded down.
    low = F.col("positive_score") - F.floor(F.col("positive_score") / F.lit(5).cast("decimal(20,0)"))
    windows = positives.withColumn("x", _window(low, F.col("positive_score"))).groupBy(
        F.col("anchor_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("p", "x"))).alias("l")).select(
        "id", F.transform("l", lambda y: y["x"]).alias("windows"))
    found = held.first(stored(windows, "windows"), False, NEGATIVES).select(
        F.col("anchor").alias("anchor_id"), (F.col("w") + 1).alias("p"), F.col("rank"),
        F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    return positives.join(found, ["anchor_id", "p"]).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


SQL = """
WITH rows AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (
  SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same,
         CAST(list_dot_product(a.v, r.v) AS BIGINT) AS score
  FROM rows a JOIN rows r ON a.vec_id <> r.vec_id WHERE a.vec_id % 100 = 0),
positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scores WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id,
       CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
       vec_id AS negative_id, positive_score, score AS negative_score
FROM positives p JOIN scores s ON p.anchor_id = s.anchor_id AND NOT same
  AND 80 * positive_score <= 100 * score AND score <= positive_score
QUALIFY rank <= 5
"""
