"""Quality classifier: an additive model with pairwise interactions (operator 1).

Every feature of a text is binned; a lookup table per feature, and one per chosen pair of
features, is learnt by cyclic boosting of shallow trees over the bins. A text's score is the
logistic of the sum of its table entries, so scoring is a few vectorised look-ups.

The model is fitted on at most ``SAMPLE`` labelled documents, those with the smallest hash of
their id. All documents are scored in one pass without a shuffle.

Defined results: null and empty texts are scored as texts without words; texts are read whole,
a score depends on its text alone;
a null doc_id is not held out and is never learnt from; repeated rows score alike; labels without
a quality, or all of one class, leave a constant score, the share of label 1 (0.5 without any);
empty tables give empty results; extra columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from noticelake.llm import tokens as tk

SAMPLE = 20_000
THRESHOLD = 0.3
BINS = 32
PAIR_BINS = 8
PAIRS = 6
ROUNDS = 200
PAIR_ROUNDS = 80
RATE = 0.1
#: Added to the weight of a leaf, and the least number of rows in one.
SMOOTH, LEAF = 1.0, 20

_BYTES = np.arange(256)
_IS = {
    "upper": (_BYTES >= 65) & (_BYTES <= 90),
    "lower": (_BYTES >= 97) & (_BYTES <= 122),
    "digit": (_BYTES >= 48) & (_BYTES <= 57),
    "beyond": _BYTES >= 128,
    "symbol": np.isin(_BYTES, list(b"#*$%&|<>@^~=_+{}[]\\")),
    "loud": np.isin(_BYTES, list(b"!?")),
    "stop": np.isin(_BYTES, list(b".,;:")),
    "line": _BYTES == 10,
}
FEATURES = [*_IS, "words", "word_bytes", "distinct", "same_as_before", "one_letter_words",
            "symbol_words", "capital_words", "repeated_pairs"]


def _per_document(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    upto = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return upto[offsets[1:]] - upto[offsets[:-1]]


def _distinct(values: np.ndarray, document: np.ndarray, n: int) -> np.ndarray:
    pairs = np.sort((tk.mix(values) & ~np.uint64(0xFFFFF)) | document.astype(np.uint64))
    new = np.ones(len(pairs), bool)
    new[1:] = pairs[1:] != pairs[:-1]
    return np.bincount((pairs[new] & np.uint64(0xFFFFF)).astype(np.int64), minlength=n)


def features(texts: pa.Array) -> np.ndarray:
    """One row of ``FEATURES`` for each text, from all its bytes and words."""
    out = np.zeros((len(texts), len(FEATURES)))
    with np.errstate(over="ignore"):
        for chunk in tk.chunks(texts):
            n = chunk.documents
            kinds = {k: np.concatenate([[0], np.cumsum(v[chunk.data], dtype=np.int32)]) for k, v in _IS.items()}
            first = chunk.bounds
            total = np.maximum(np.diff(first), 1)
            words = np.diff(chunk.offsets)
            some = np.maximum(words, 1)
            document = chunk.document_of()
            size = chunk.ends - chunk.starts
            in_word = {k: v[chunk.ends] - v[chunk.starts] for k, v in kinds.items()}
            letters = size - in_word["symbol"] - in_word["stop"] - in_word["loud"] - in_word["digit"]
            same = np.zeros(len(size), bool)
            same[1:] = (chunk.hashes[1:] == chunk.hashes[:-1]) & (document[1:] == document[:-1])
            # Two words that follow each other in one document.
            pairs = chunk.hashes[:-1] + chunk.hashes[1:] * np.uint64(0x9E3779B97F4A7C15)
            inside = document[1:] == document[:-1]
            pairs, of_pair = pairs[inside], document[:-1][inside]
            rows = [(v[first[1:]] - v[first[:-1]]) / total for v in kinds.values()]
            rows += [
                np.log1p(words), _per_document(size, chunk.offsets) / some,
                _distinct(chunk.hashes, document, n) / some,
                _per_document(same, chunk.offsets) / some,
                _per_document(size == 1, chunk.offsets) / some,
                _per_document(in_word["symbol"] * 2 >= size, chunk.offsets) / some,
                _per_document((in_word["upper"] == letters) & (letters > 1), chunk.offsets) / some,
                (np.maximum(words - 1, 0) - _distinct(pairs, of_pair, n)) / np.maximum(words - 1, 1),
            ]
            out[chunk.first: chunk.first + n] = np.stack(rows, axis=1)
    return out


@dataclass
class Model:
    """Bin edges and lookup tables; ``intercept`` alone where nothing could be learnt."""

    intercept: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pair_edges: list[np.ndarray] = field(default_factory=list)
    pairs: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        for f, (edges, table) in enumerate(zip(self.edges, self.tables, strict=True)):
            total += table[np.searchsorted(edges, x[:, f], "right")]
        coarse = {f: np.searchsorted(self.pair_edges[f], x[:, f], "right") for p in self.pairs for f in p}
        for (f, g), table in self.pairs.items():
            total += table[coarse[f], coarse[g]]
        return 1 / (1 + np.exp(-total))


def _edges(column: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(column, np.arange(1, bins) / bins, method="higher"))


def _step(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Values per bin of a tree with up to three leaves, cut where the gain is largest."""
    cuts: list[int] = []
    for _ in range(2):
        bounds, best = [0, *cuts, len(g)], (1e-9, None)
        for a, b in zip(bounds, bounds[1:], strict=False):
            if b - a < 2:
                continue
            gl, hl, nl = (np.cumsum(v[a:b])[:-1] for v in (g, h, n))
            gt, ht, nt = g[a:b].sum(), h[a:b].sum(), n[a:b].sum()
            gain = gl**2 / (hl + SMOOTH) + (gt - gl) ** 2 / (ht - hl + SMOOTH) - gt**2 / (ht + SMOOTH)
            gain[(nl < LEAF) | (nt - nl < LEAF)] = 0
            i = int(np.argmax(gain))
            if gain[i] > best[0]:
                best = (gain[i], a + i + 1)
        if best[1] is None:
            break
        cuts = sorted([*cuts, best[1]])
    out = np.empty(len(g))
    for a, b in zip([0, *cuts], [*cuts, len(g)], strict=True):
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + SMOOTH)
    return out if cuts else np.zeros(len(g))


def _quadrants(g: np.ndarray, h: np.ndarray):
    """The best cut of a grid into four leaves: its gain and their values on the grid."""
    best, values = 0.0, np.zeros(g.shape)
    sums = [np.pad(v.cumsum(0).cumsum(1), ((1, 0), (1, 0))) for v in (g, h)]
    i, j = (v.ravel() for v in np.meshgrid(range(1, g.shape[0]), range(1, g.shape[1]), indexing="ij"))
    if not len(i):
        return best, values
    parts = [(s[i, j], s[i, -1] - s[i, j], s[-1, j] - s[i, j], s[-1, -1] - s[i, -1] - s[-1, j] + s[i, j])
             for s in sums]
    gain = sum(a**2 / (b + SMOOTH) for a, b in zip(*parts, strict=True))
    at = int(np.argmax(gain))
    leaf = [a[at] / (b[at] + SMOOTH) for a, b in zip(*parts, strict=True)]
    values[: i[at], : j[at]], values[: i[at], j[at]:] = leaf[0], leaf[1]
    values[i[at]:, : j[at]], values[i[at]:, j[at]:] = leaf[2], leaf[3]
    return float(gain[at]), values


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    share = (y.sum() + 0.5) / (len(y) + 1) if len(y) else 0.5
    model = Model(float(np.log(share / (1 - share))))
    if not 0 < y.sum() < len(y):
        return model
    model.edges = [_edges(x[:, f], BINS) for f in range(x.shape[1])]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    bins = [np.searchsorted(e, x[:, f], "right") for f, e in enumerate(model.edges)]
    counts = [np.bincount(b, minlength=len(t)) for b, t in zip(bins, model.tables, strict=True)]
    total = np.full(len(y), model.intercept)

    def slopes():
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for f, b in enumerate(bins):
            g, h = (np.bincount(b, v, len(model.tables[f])) for v in slopes())
            step = RATE * _step(g, h, counts[f])
            model.tables[f] += step
            total += step[b]
    model.pair_edges = [_edges(x[:, f], PAIR_BINS) for f in range(x.shape[1])]
    coarse = [np.searchsorted(e, x[:, f], "right") for f, e in enumerate(model.pair_edges)]

    def grid(f, g):
        shape = (len(model.pair_edges[f]) + 1, len(model.pair_edges[g]) + 1)
        cell = coarse[f] * shape[1] + coarse[g]
        return cell, [np.bincount(cell, v, shape[0] * shape[1]).reshape(shape) for v in slopes()]

    gains = {p: _quadrants(*grid(*p)[1])[0] for p in combinations(range(x.shape[1]), 2)}
    chosen = sorted(gains, key=lambda p: (-gains[p], p))[:PAIRS]
    model.pairs = {p: np.zeros(grid(*p)[1][0].shape) for p in chosen}
    for _ in range(PAIR_ROUNDS):
        for p in chosen:
            cell, sums = grid(*p)
            step = RATE * _quadrants(*sums)[1]
            model.pairs[p] += step
            total += step.ravel()[cell]
    return model


def held_out():
    """Documents that are never learnt from: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model of ``labels.quality``, from at most ``sample`` documents that are not held out."""
    learnt = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out())
    chosen = learnt.select("doc_id", F.col("quality").cast("double").alias("quality")).orderBy(
        F.xxhash64("doc_id"), "doc_id", "quality").limit(sample)
    # The limit is the size bound of this broadcast.
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")

    @tk.tidy
    def emit(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            rows = pa.array(features(batch.column("text")).ravel())
            at = pa.array((np.arange(batch.num_rows + 1) * len(FEATURES)).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("quality"), pa.ListArray.from_arrays(at, rows)],
                ["doc_id", "quality", "x"])

    found = texts.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "quality").mapInArrow(
        emit, "doc_id long, quality double, x array<double>").toArrow()
    ids, y = found["doc_id"].to_numpy(), found["quality"].to_numpy()
    x = found["x"].combine_chunks().flatten().to_numpy().reshape(len(y), len(FEATURES))
    order = np.lexsort((*x.T, y, ids))  # the same model whatever the order of arrival
    return fit(x[order], y[order])


def scored(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """``docs`` with a score between 0 and 1 in a new column ``name``."""
    tk.bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @tk.tidy
    def emit(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            score = pa.array(shared.value.score(features(batch.column("text"))))
            yield pa.RecordBatch.from_arrays([*batch.columns, score], [*batch.schema.names, name])

    return docs.mapInArrow(emit, StructType([*docs.schema, StructField(name, DoubleType())]))


def keep_good(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without those that score below ``threshold``. Extra columns may have any name."""
    plain, named = tk.plain_names(docs)
    return named(scored(plain, model, "_score").filter(F.col("_score") >= threshold))
