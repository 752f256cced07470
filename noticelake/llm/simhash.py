"""SimHash near-dedup by anchor points of a covering code (operator 4).

Fingerprints of 64 bits are taken from all shingles of a text; equal ones are one point from then
on. The 64 bits are cut into ``SEGMENTS`` parts, so two points within ``THRESHOLD`` bits differ
in at most ``THRESHOLD // SEGMENTS`` bits of some part. The anchors of a part are the words of a
covering code: the perfect Hamming code of length 15 (covering radius 1) next to plain bits. A
point's home is its nearest anchor; it is replicated to every anchor that can be home to a point
within the part's threshold, that is within covering radius plus threshold. Each anchor compares
its points. Anchors with many points are cut into pairs of blocks, and links are thinned to a
forest per comparison, so a dense group of near copies emits no more links than it has points.

Defined results: null text is empty; no word gives fingerprint zero, linked like any other; texts
are taken whole; equal texts share a fingerprint; repeated rows each get a row; a null id gets a
fingerprint and its component's smallest id (null if there is none); an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticelake.llm import similar
from noticelake.llm import tokens as tk
from noticelake.llm.components import components
from noticelake.llm.repeats import stored

WORDS = 4
SEED = 42
THRESHOLD = 4
SEGMENTS = 3
CODE = 15
#: Points of one anchor that are compared in one piece. More are cut into blocks.
BLOCK = 50_000
#: Comparisons made at once.
AT_ONCE = 1 << 21
_U = np.uint64


def fingerprints(texts: pa.Array, words: int = WORDS) -> np.ndarray:
    out = np.zeros(len(texts), _U)
    digest = xxhash.xxh64_intdigest
    for chunk in tk.chunks(texts, tk.SPACES, tk.LOWER):
        count = np.diff(chunk.offsets)
        if not len(chunk.hashes):
            continue
        # The words again, with one space after each.
        size = chunk.ends - chunk.starts + 1
        ends = np.cumsum(size)
        take = np.arange(ends[-1]) - np.repeat(ends - size, size) + np.repeat(chunk.starts, size)
        data = np.append(chunk.data, np.uint8(32))[take]
        data[ends - 1] = 32
        data = data.tobytes()
        shingles = np.where(count > 0, np.maximum(count - words + 1, 1), 0)
        owner = np.repeat(np.arange(chunk.documents), shingles)
        first = np.arange(len(owner)) - np.repeat(np.cumsum(shingles) - shingles, shingles)
        first += chunk.offsets[owner]
        last = np.minimum(first + words, chunk.offsets[owner + 1]) - 1
        a, b = (ends - size)[first].tolist(), (ends - 1)[last].tolist()
        h = np.fromiter((digest(data[i:j], SEED) for i, j in zip(a, b, strict=True)), _U, len(a))
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        some = np.flatnonzero(shingles)
        at = (np.cumsum(shingles) - shingles)[some]
        ones = np.add.reduceat(bits, at, axis=0, dtype=np.int32)
        major = np.packbits(2 * ones > shingles[some][:, None], axis=1, bitorder="little")
        out[chunk.first + some] = major.view(_U)[:, 0]
    return out


def _nearest() -> np.ndarray:
    """For every word of ``CODE`` bits the code word at a distance of at most one."""
    x = np.arange(1 << CODE)
    syndrome = np.zeros_like(x)
    for bit in range(CODE):
        syndrome ^= np.where(x >> bit & 1, bit + 1, 0)
    return x ^ np.where(syndrome > 0, 1 << np.maximum(syndrome - 1, 0), 0)


NEAREST = _nearest().astype(_U)
_CODE_MASK = _U((1 << CODE) - 1)


def segments(n: int = SEGMENTS) -> list[tuple[int, int]]:
    """Shift and width of each part of the 64 bits."""
    edges = [64 * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def home(part: np.ndarray, width: int) -> np.ndarray:
    if width < CODE:
        return part
    return (part & ~_CODE_MASK) | NEAREST[(part & _CODE_MASK).astype(np.int64)]


def _anchors(threshold: int, n: int):
    @tk.tidy
    def emit(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            points = batch.column("fp").to_numpy().view(_U)
            for i, (shift, width) in enumerate(segments(n)):
                part = points >> _U(shift) & _U((1 << width) - 1)
                flips = [sum(1 << b for b in c) for k in range(threshold // n + 1)
                         for c in combinations(range(width), k)]
                homes = np.stack([home(part ^ _U(f), width) for f in flips], axis=1)
                homes.sort(axis=1)
                new = np.ones(homes.shape, bool)
                new[:, 1:] = homes[:, 1:] != homes[:, :-1]
                row, _ = np.nonzero(new)
                yield pa.RecordBatch.from_arrays([
                    pa.array((homes[new] | _U(i << 60)).view(np.int64)),
                    pa.array(points[row].view(np.int64)),
                ], ["anchor", "fp"])

    return emit


def _is_home(anchor: np.ndarray, points: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(len(points), bool)
    which = anchor >> _U(60)
    for i, (shift, width) in enumerate(segments(n)):
        mine = which == i
        part = points[mine] >> _U(shift) & _U((1 << width) - 1)
        out[mine] = home(part, width) == anchor[mine] & _U((1 << 60) - 1)
    return out


def _forest(points: np.ndarray, at_home: np.ndarray, threshold: int):
    """Links that join all that ``threshold`` joins: a search that never looks back."""
    left, u, v = np.arange(len(points)), [], []
    while len(left):
        queue, left = [left[-1]], left[:-1]
        while queue and len(left):
            x = queue.pop()
            near = np.bitwise_count(points[left] ^ points[x]) <= threshold
            if not at_home[x]:
                near &= at_home[left]
            found = left[near]
            if len(found):
                queue.extend(found)
                left = left[~near]
                u.append(np.repeat(points[x], len(found)))
                v.append(points[found])
    return (np.concatenate(u), np.concatenate(v)) if u else (points[:0], points[:0])


def _links_of(points: np.ndarray, sizes: np.ndarray, at_home: np.ndarray, threshold: int):
    """Links inside groups that follow each other. Homes are compared with all points."""
    begins = np.cumsum(sizes) - sizes
    group = np.repeat(np.arange(len(sizes)), sizes)
    homes = np.add.reduceat(at_home.astype(np.int64), begins)
    large = homes * sizes > AT_ONCE
    us, vs = [], []

    def thinned(g):
        part = slice(begins[g], begins[g] + sizes[g])
        u, v = _forest(points[part], at_home[part], threshold)
        us.append(u)
        vs.append(v)

    rows = np.flatnonzero(at_home & ~large[group] & (sizes[group] > 1))
    total = np.cumsum(sizes[group[rows]])
    done = 0
    while done < len(rows):
        upto = max(done + 1, int(np.searchsorted(total, (total[done - 1] if done else 0) + AT_ONCE)))
        i = rows[done:upto]
        g = group[i]
        n = sizes[g]
        x = np.repeat(i, n)
        y = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begins[g], n)
        near = (np.bitwise_count(points[x] ^ points[y]) <= threshold) & (x != y)
        x, y = x[near], y[near]
        many = np.bincount(group[x], minlength=len(sizes)) > sizes
        ok = ~many[group[x]]
        us.append(points[x[ok]])
        vs.append(points[y[ok]])
        for g in np.flatnonzero(many):
            thinned(g)
        done = upto
    for g in np.flatnonzero(large):
        thinned(g)
    return np.concatenate(us or [points[:0]]), np.concatenate(vs or [points[:0]])


def _compare(threshold: int, n: int):
    """Links of each anchor and block pair; the rows come sorted by both."""

    @tk.tidy
    def emit(batches: Iterator[pa.RecordBatch]):
        held: list[np.ndarray] = []

        def ready(rows: np.ndarray):
            anchor, points = rows[0].view(_U), rows[3].view(_U)
            edge = np.flatnonzero(np.r_[True, (rows[:3, 1:] != rows[:3, :-1]).any(axis=0)])
            sizes = np.diff(np.append(edge, rows.shape[1]))
            u, v = _links_of(points, sizes, _is_home(anchor, points, n), threshold)
            links = np.unique(np.stack([np.minimum(u, v), np.maximum(u, v)]), axis=1)
            return pa.RecordBatch.from_arrays(
                [pa.array(links[0].view(np.int64)), pa.array(links[1].view(np.int64))], ["u", "v"]
            )

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.stack([batch.column(c).to_numpy().astype(np.int64)
                             for c in ("anchor", "i", "j", "fp")])
            # The last group may go on in the next batch.
            same = (rows[:3] == rows[:3, -1:]).all(axis=0)
            whole = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
            if whole:
                yield ready(np.concatenate([*held, rows[:, :whole]], axis=1))
                held = []
            held.append(rows[:, whole:])
        if held:
            yield ready(np.concatenate(held, axis=1))

    return emit


def links(points: DataFrame, threshold: int = THRESHOLD, n: int = SEGMENTS, block: int = BLOCK) -> DataFrame:
    """Links (u, v) that connect all fingerprints ``fp`` within ``threshold`` bits of each other."""
    rows = points.mapInArrow(_anchors(threshold, n), "anchor long, fp long")
    crowded = stored(
        rows.groupBy("anchor").count().filter(F.col("count") > block)
        .select("anchor", F.ceil(F.col("count") / block).cast("int").alias("blocks")), "crowded")
    blocks = F.coalesce("blocks", F.lit(1))
    mine = F.pmod(F.xxhash64("fp"), blocks).cast("int")
    rows = rows.join(crowded, "anchor", "left").select(
        "anchor", "fp", mine.alias("mine"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other")
    ).select("anchor", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "fp")
    return (
        rows.repartition("anchor", "i", "j").sortWithinPartitions("anchor", "i", "j")
        .mapInArrow(_compare(threshold, n), "u long, v long")
    )


def _prints(words: int):
    @tk.tidy
    def emit(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            found = fingerprints(batch.column("text"), words).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(found)], ["id", "fp"])

    return emit


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", words: int = WORDS,
                    threshold: int = THRESHOLD) -> DataFrame:
    """Per row its ``id``, ``fp`` (the 64 bits as a long) and ``component``, the smallest id that
    a chain of links reaches."""
    tk.bound_batches(docs.sparkSession)
    ids = docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text"))
    prints = stored(ids.mapInArrow(_prints(words), "id long, fp long"), "fingerprints")
    points = stored(prints.groupBy("fp").agg(F.min("id").alias("first")), "points")
    roots = components(links(points.select("fp"), threshold))
    rooted = points.join(roots, points["fp"] == roots["node"], "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component"))
    labels = rooted.join(smallest, "root").select("fp", "component")
    return prints.join(labels, "fp").select("id", "fp", "component")


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` without near copies: of each group of similar texts the smallest doc_id.

    Groups are chains of links of two kinds: fingerprints within ``THRESHOLD`` bits, found by the
    anchors above, and a similarity of 0.8 or more over 5 words, see ``similar.py``. Documents without a doc_id come before those with one. Different texts of one doc_id are judged
    each for itself; of rows that repeat both, one stays. Extra columns may have any name.
    """
    plain, named = tk.plain_names(docs)
    keyed = tk.document_key(plain).withColumn("_point", F.xxhash64(F.coalesce("text", F.lit(""))))
    prints = near_duplicates(keyed, "_point").select(F.col("id").alias("u"), F.col("component").alias("v"))
    linked = stored(prints.filter("u <> v").distinct(), "fingerprint-links")
    first = similar.groups(keyed, known=linked).groupBy("root").agg(F.min(F.struct("first", "point")).alias("f"))
    keep = first.select(F.col("f.first").alias("_key"), F.col("f.point").alias("_point"))
    return named(keyed.join(keep, ["_key", "_point"], "left_semi").dropDuplicates(["_key", "_point"]))
