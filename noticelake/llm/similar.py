"""Groups of texts with a Jaccard similarity of ``SIMILARITY`` or more (stage near_dedup).

A text is the set of its stretches of ``WORDS`` words; one with fewer words has one stretch. At a
similarity of 0.8 fingerprints of 64 bits differ in about 10 bits, too far for the anchors of
operator 4, so candidates are found by ``BANDS`` keys of ``ROWS`` minimal hashes each: a pair of
exactly 0.8 shares no key with a chance of (1 - 0.8**5)**25 = 5e-5, a closer one with a smaller
chance. A byte of each of the 125 hashes is kept as a sketch; a pair that shares a key but agrees in
less than ``ALIKE`` of the sketch (three standard deviations below 0.8) is dropped before any text
moves, which keeps texts with common boilerplate apart. Every link is verified by exact similarity.

1. Members of a key are compared with one hub, in ``ROUNDS`` rounds with different hubs, one
   comparison a round for each text. Large groups of copies become one component here.
2. In keys that still hold several components all other members are compared, by sketches, with
   those outside the largest one, in pairs of blocks. Only the members that have a partner are kept,
   a row each, not a row per pair.
3. Texts go to these members, once per block; a task verifies pairs until the components in its
   blocks are joined, and emits the links that join them, at most one per member.

Rows that leave a task therefore grow with the members of a key and not with their pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticelake.llm import tokens as tk
from noticelake.llm.bitmaps import bitmap_of
from noticelake.llm.components import components
from noticelake.llm.repeats import _having, stored

WORDS = 5
SIMILARITY = 0.8
BANDS = 25
ROWS = 5
#: Least share of equal sketch bytes of a pair whose texts are compared.
ALIKE = 0.69
ROUNDS = 2
#: Members of a block, where a text of up to ``HEAVY`` characters counts as one.
BLOCK = 512
HEAVY = 32_768
#: Pairs of sketches compared at once.
AT_ONCE = 1 << 17
_U = np.uint64
_RANDOM = np.random.default_rng(11)
_FLIP = _RANDOM.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64)
_TIMES = _RANDOM.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) * _U(2) + _U(1)


def _shingles(chunk: tk.Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the stretches of each document, and how many it has."""
    count = np.diff(chunk.offsets)
    n = np.where(count > 0, np.maximum(count - WORDS + 1, 1), 0)
    owner = np.repeat(np.arange(chunk.documents), n)
    first = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n) + chunk.offsets[owner]
    last = np.minimum(first + WORDS, chunk.offsets[owner + 1])
    return tk.WORDS.of(tk.WORDS.prefix(chunk.hashes), first, last), n


def bands(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The keys of each text and its sketch. Texts without a word share theirs."""
    out = np.zeros((len(texts), BANDS), _U)
    sketch = np.zeros((len(texts), BANDS * ROWS), np.uint8)
    with np.errstate(over="ignore"):
        out[:] = tk.mix(np.arange(BANDS, dtype=np.uint64))
        for chunk in tk.chunks(texts, tk.SPACES, tk.LOWER):
            h, n = _shingles(chunk)
            some = np.flatnonzero(n)
            if not len(some):
                continue
            at = (np.cumsum(n) - n)[some]
            for b in range(BANDS):
                key = np.full(len(some), _U(b))
                for i in range(b * ROWS, b * ROWS + ROWS):
                    least = tk.mix(np.minimum.reduceat((h ^ _FLIP[i]) * _TIMES[i], at))
                    sketch[chunk.first + some, i] = least.astype(np.uint8)
                    key = tk.mix(key + least)
                out[chunk.first + some, b] = key
    return out, sketch


def sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """The sorted different stretches of each text."""
    with np.errstate(over="ignore"):
        for chunk in tk.chunks(texts, tk.SPACES, tk.LOWER):
            h, n = _shingles(chunk)
            for part in np.split(h, np.cumsum(n)[:-1]):
                yield np.unique(part)


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Two empty sets are alike."""
    if min(len(a), len(b)) < SIMILARITY * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both * 5 >= 4 * (len(a) + len(b) - both)


@tk.tidy
def _keys(batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        found, sketch = bands(batch.column("text"))
        at = pa.array((np.arange(len(found) + 1) * BANDS).astype(np.int32))
        yield pa.RecordBatch.from_arrays([
            batch.column("_key"), batch.column("_point"),
            pa.ListArray.from_arrays(at, pa.array(found.view(np.int64).ravel())),
            pa.array([x.tobytes() for x in sketch], pa.binary()), batch.column("_size")],
            ["key", "point", "bands", "sketch", "size"])


def _matrix(sketches: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(sketches.to_pylist()), np.uint8).reshape(len(sketches), BANDS * ROWS)


@tk.tidy
def _promising(batches: Iterator[pa.RecordBatch]):
    """Pairs (u, v) whose sketches are alike."""
    for batch in batches:
        ok = (_matrix(batch.column("su")) == _matrix(batch.column("sv"))).mean(axis=1) >= ALIKE
        yield batch.select(["u", "v"]).filter(pa.array(ok, pa.bool_()))


@tk.tidy
def _verify(batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        ok = [similar(a, b) for a, b in zip(sets(batch.column("t")), sets(batch.column("s")), strict=True)]
        yield batch.select(["u", "v"]).filter(pa.array(ok, pa.bool_()))


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows sorted by (band, i, j), whole groups at a time."""
    held: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("band", "i", "j")])
        other = np.flatnonzero((keys != keys[:, -1:]).any(axis=0))
        whole = int(other[-1]) + 1 if len(other) else 0  # the last group may go on in the next batch
        if held:
            before = [held[-1].column(c)[-1].as_py() for c in ("band", "i", "j")]
            if whole or before != keys[:, -1].tolist():
                upto = whole if whole else 0
                yield pa.concat_tables([*held, pa.Table.from_batches([batch.slice(0, upto)])]).combine_chunks()
                held = []
        elif whole:
            yield pa.Table.from_batches([batch.slice(0, whole)]).combine_chunks()
        held.append(pa.Table.from_batches([batch.slice(whole)]))
    if held:
        yield pa.concat_tables(held).combine_chunks()


def _pairs(table: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows (x, y) of one group whose sketches are alike and whose roots differ, x on the near side."""
    keys = np.stack([table[c].to_numpy().astype(np.int64) for c in ("band", "i", "j")])
    edge = np.flatnonzero(np.append(True, (keys[:, 1:] != keys[:, :-1]).any(axis=0)))
    group = np.cumsum(np.isin(np.arange(table.num_rows), edge)) - 1
    near, root = table["near"].to_numpy(zero_copy_only=False), table["root"].to_numpy()
    sketch = _matrix(table["sketch"].chunk(0) if table["sketch"].num_chunks else pa.array([], pa.binary()))
    far = np.flatnonzero(~near)  # sorted by group, as all rows are
    begin, size = np.searchsorted(group[far], np.arange(len(edge))), np.bincount(group[far], minlength=len(edge))
    rows = np.flatnonzero(near)
    rows = rows[size[group[rows]] > 0]
    total, done = np.cumsum(size[group[rows]]), 0
    while done < len(rows):
        upto = max(done + 1, int(np.searchsorted(total, (total[done - 1] if done else 0) + AT_ONCE)))
        x = rows[done:upto]
        n = size[group[x]]
        y = far[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin[group[x]], n)]
        x = np.repeat(x, n)
        other = root[x] != root[y]
        x, y = x[other], y[other]
        ok = (sketch[x] == sketch[y]).mean(axis=1) >= ALIKE
        yield x[ok], y[ok]
        done = upto


@tk.tidy
def _partners(batches: Iterator[pa.RecordBatch]):
    """Members that have a partner in their group; the sketches told so."""
    for table in _groups(batches):
        keep = np.zeros(table.num_rows, bool)
        for x, y in _pairs(table):
            keep[x] = keep[y] = True
        yield from table.filter(pa.array(keep)).to_batches()


@tk.tidy
def _joined(batches: Iterator[pa.RecordBatch]):
    """Verified links that join the roots of each group."""
    for table in _groups(batches):
        found = list(sets(table["text"].chunk(0))) if table.num_rows else []
        point, root = table["point"].to_numpy(), table["root"].to_numpy()
        group = [tuple(k) for k in zip(*(table[c].to_pylist() for c in ("band", "i", "j")), strict=True)]
        above: dict[tuple, tuple] = {}

        def top(node, above=above):
            while (up := above.get(node, node)) != node:
                above[node] = above.get(up, up)
                node = up
            return node

        u, v = [], []
        for xs, ys in _pairs(table):
            for x, y in zip(xs.tolist(), ys.tolist(), strict=True):
                a, b = top((group[x], root[x])), top((group[x], root[y]))
                if a != b and similar(found[x], found[y]):
                    above[a] = b
                    u.append(point[x])
                    v.append(point[y])
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])


def _crossed(rooted: DataFrame, points: DataFrame, block: int) -> DataFrame:
    """Members of keys with several roots in groups (band, i, j): the members outside the largest
    root's component, near, meet all members of the key, far, in pairs of blocks."""
    split = rooted.groupBy("band").agg(F.min("root").alias("a"), F.max("root").alias("z")).filter("a != z")
    members = rooted.join(split.select("band"), "band").join(points.select("point", "sketch", "size"), "point").withColumn(
        "w", 1 + F.floor(F.col("size") / HEAVY))
    roots = members.groupBy("band", "root").agg(F.sum("w").alias("w"), F.count("*").alias("n"))
    largest = roots.groupBy("band").agg(
        F.max_by("root", F.struct("n", "root")).alias("largest"), F.sum("w").alias("all"), F.max_by(
            "w", F.struct("n", "root")).alias("most"))
    largest = largest.select("band", "largest", F.ceil(F.col("all") / block).cast("int").alias("js"),
                             F.ceil((F.col("all") - F.col("most")) / block).cast("int").alias("is"))
    members = stored(members.join(largest, "band"), "split-members")
    i, j = (F.pmod(F.xxhash64("point", F.lit(seed)), F.greatest(F.col(n), F.lit(1))).cast("int") for seed, n in ((1, "is"), (2, "js")))
    shape = ["band", "point", "root", "sketch"]
    near = members.filter("root != largest").select(
        *shape, i.alias("i"), F.explode(F.sequence(F.lit(0), F.col("js") - 1)).alias("j"), F.lit(True).alias("near"))
    far = members.select(
        *shape, F.explode(F.sequence(F.lit(0), F.col("is") - 1)).alias("i"), j.alias("j"), F.lit(False).alias("near"))
    return near.unionByName(far)


def _dealt(rows: DataFrame) -> DataFrame:
    return rows.repartition("band", "i", "j").sortWithinPartitions("band", "i", "j")


def groups(keyed: DataFrame, block: int = BLOCK, known: DataFrame | None = None) -> DataFrame:
    """``keyed`` (_key, _point, text), a point for each different text -> ``point``, ``first``
    (the smallest key with that text) and ``root``, a point that all of a component share.

    ``known`` are stored links (u, v) of points found another way: they count like those found here,
    and what they join is not compared again."""
    tk.bound_batches(keyed.sparkSession)
    keyed = keyed.select("_key", "_point", "text")
    keys = keyed.withColumn("_size", F.coalesce(F.length("text"), F.lit(0)).cast("long")).mapInArrow(
        _keys, "key long, point long, bands array<long>, sketch binary, size long")
    points = stored(keys.groupBy("point").agg(
        F.min("key").alias("first"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"),
        F.first("size").alias("size")), "points")
    every = points.select("point", F.explode("bands").alias("band"))
    shared = every.groupBy("band").count().filter("count > 1").select("band")
    members = stored(every.join(shared, "band"), "members")
    wanted = stored(points.select("point", "first").join(members.select("point").distinct(), "point"), "wanted")
    # Only one row of each text that has candidates.
    near = keyed.sparkSession.sparkContext.broadcast(bitmap_of(wanted, "point"))
    texts = keyed.withColumnRenamed("_key", "_id").withColumnRenamed("_point", "_key")
    texts = texts.mapInArrow(_having(near), texts.schema).withColumnRenamed("_key", "point")
    texts = stored(texts.join(wanted, (texts["point"] == wanted["point"]) & texts["_id"].eqNullSafe(wanted["first"])).select(
        texts["point"], "text").dropDuplicates(["point"]), "candidate-texts")
    near.destroy()

    def rooted_by(found: list[DataFrame]) -> DataFrame:
        roots = components(reduce(DataFrame.unionByName, found))
        return stored(points.select("point", "first").join(roots, points["point"] == roots["node"], "left").select(
            "point", "first", F.coalesce("root", "point").alias("root")), "roots")

    found: list[DataFrame] = [] if known is None else [known]
    rooted = members.withColumn("root", F.col("point"))
    if found:
        rooted = members.join(rooted_by(found).select("point", "root"), "point")
    for n in range(ROUNDS):
        split = rooted.groupBy("band").agg(F.min("root").alias("a"), F.max("root").alias("z")).filter("a != z")
        hubs = rooted.groupBy("band").agg(F.min_by(
            F.struct("point", "root"), F.struct(F.xxhash64("point", F.lit(n)), "point")).alias("hub"))
        hubs = hubs.join(split, "band").select("band", F.col("hub.point").alias("v"), F.col("hub.root").alias("r"))
        pairs = rooted.join(hubs, "band").filter("root != r").groupBy(F.col("point").alias("u")).agg(
            F.min_by("v", F.xxhash64("v", F.lit(n))).alias("v"))
        sketches = points.select(F.col("point").alias("u"), F.col("sketch").alias("su"))
        others = points.select(F.col("point").alias("v"), F.col("sketch").alias("sv"))
        pairs = stored(pairs.join(sketches, "u").join(others, "v").mapInArrow(_promising, "u long, v long"), "pairs")
        one = texts.select(F.col("point").alias("u"), F.col("text").alias("t"))
        two = texts.select(F.col("point").alias("v"), F.col("text").alias("s"))
        found.append(stored(pairs.join(one, "u").join(two, "v").select("u", "v", "t", "s").mapInArrow(
            _verify, "u long, v long"), "links"))
        rooted = members.join(rooted_by(found).select("point", "root"), "point")
    crossed = _dealt(_crossed(rooted, points, block))
    partners = stored(crossed.mapInArrow(_partners, crossed.schema), "partners")
    last = _dealt(partners.join(texts, "point").select(*partners.columns, "text"))
    found.append(stored(last.mapInArrow(_joined, "u long, v long"), "links"))
    return rooted_by(found)
