"""Toxicity by bags of subwords (operator 12).

A word is the average of the vectors of its character n-grams and of the word as a whole; a stretch
of at most ``STRETCH`` words is the average of its different words; a linear softmax over that vector
says how toxic the stretch is. Vectors and softmax are trained jointly in numpy, so a misspelling that was
never seen shares most of its vectors with the word that was. A document is as toxic as its worst
stretch, so a few words count in a long text as they do in a short one; in training the worst
stretch of each document is chosen anew in every round.

The model is fitted on at most ``SAMPLE`` labelled documents of each class, those with the smallest
hash of their id, and at most ``STRETCHES`` stretches of each, at even distances; classes are
weighted by their full counts. N-grams in fewer than ``LEAST`` of them have no vector; steps are plain
gradients, longer for rarer n-grams; one document in ``APART`` is left out and calibrates the score by
a line through the logits, so that what documents share by chance says little. All documents are scored whole, in one pass without a shuffle. A
scored n-gram is one number, its vector times the difference of the softmax's two columns.

Defined results: null and empty texts have the score of an average of nothing; letters are folded
to lower case; a null doc_id is not held out and never learnt from; repeated rows score alike;
labels without ``toxic``, or all of one class, leave a constant score, the share of label 1 (0.5
without any); empty tables give empty results; extra columns pass through; ``scored`` refuses to
overwrite a column.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from noticelake.llm import tokens as tk

SAMPLE = 4_000
THRESHOLD = 0.7
STRETCH = 12
STRETCHES = 128
#: Lengths of n-grams in characters, the number of vectors, and their length.
SIZES = (3, 4, 5)
BUCKETS = 1 << 18
WIDTH = 8
LEAST = 20
#: Rounds over the documents, at least and at most; in between as many as make so many visits.
ROUNDS, MOST_ROUNDS, VISITS = 8, 60, 60_000
#: One document in so many does not move the vectors but calibrates the score, from so many of each class on.
APART, ENOUGH = 6, 20
BATCH = 64
RATE = 0.04
#: Words without meaning that every average counts in, and what averages are multiplied by.
FILL = 4
SCALE = 12
_U = np.uint64
_BEGIN, _END, _WHOLE = _U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F), _U(0x165667B19E3779F9)


def subwords(chunk: tk.Chunk, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams of chosen words, and the word (its number in ``words``) of each."""
    starts, ends = chunk.starts[words], chunk.ends[words]
    size = ends - starts
    at = np.repeat(starts - (np.cumsum(size) - size), size) + np.arange(size.sum())
    begins = (chunk.data[at] & 0xC0) != 0x80  # not inside a character
    word, at = np.repeat(np.arange(len(words)), size)[begins], at[begins]
    beyond = np.cumsum(np.bincount(word, minlength=len(words)))[word]
    prefix = tk.BYTES.prefix(tk.byte_values(chunk.data))
    found, owner = [tk.mix(chunk.hashes[words] + _WHOLE)], [np.arange(len(words))]
    for n in SIZES:
        i = np.flatnonzero(np.arange(len(at)) + n <= beyond)
        of = word[i]
        last = i + n == beyond[i]
        end = np.where(last, ends[of], at[np.minimum(i + n, len(at) - 1)])
        found.append(tk.BYTES.of(prefix, at[i], end) + _BEGIN * (at[i] == starts[of]) + _END * last)
        owner.append(of)
    return (tk.mix(np.concatenate(found)) & _U(BUCKETS - 1)).astype(np.int32), np.concatenate(owner)


def _stretches(chunk: tk.Chunk) -> tuple[np.ndarray, np.ndarray]:
    """The stretch of each word, and how many stretches each document has."""
    words = np.diff(chunk.offsets)
    many = -(-words // STRETCH)
    inside = np.arange(len(chunk.hashes)) - np.repeat(chunk.offsets[:-1], words)
    first = np.cumsum(many) - many
    return np.repeat(first, words) + inside * np.repeat(many, words) // np.repeat(np.maximum(words, 1), words), many


def _different(stretch: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each word of a stretch once."""
    both = np.unique(stretch * np.int64(1 << 32) + word)
    return both >> 32, both & ((1 << 32) - 1)


def _chunks(texts: pa.Array) -> Iterator[tk.Chunk]:
    return tk.chunks(pc.utf8_lower(texts))


@dataclass
class Model:
    """``bias`` and the number of each bucket; no numbers where nothing could be learnt."""

    bias: float = 0.0
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))

    def score(self, texts: pa.Array) -> np.ndarray:
        out = np.full(len(texts), self.bias)
        if len(self.weights):
            with np.errstate(over="ignore"):
                for chunk in _chunks(texts):
                    if not len(chunk.hashes):
                        continue
                    _, one, again = np.unique(chunk.hashes, return_index=True, return_inverse=True)
                    found, owner = subwords(chunk, one)
                    value = np.bincount(owner, self.weights[found], len(one)) / np.bincount(owner, minlength=len(one))
                    stretch, many = _stretches(chunk)
                    stretch, again = _different(stretch, again)
                    total = SCALE * np.bincount(stretch, value[again]) / (np.bincount(stretch) + FILL)
                    some = np.flatnonzero(many)
                    out[chunk.first + some] += np.maximum.reduceat(total, (np.cumsum(many) - many)[some])
        return 1 / (1 + np.exp(-out))


def fit(texts: pa.Array, owner: np.ndarray, toxic: np.ndarray, weight: np.ndarray, seed: int = 5) -> Model:
    """A model from stretches ``texts`` of documents ``owner``, with the label and weight of each document."""
    share = (weight[toxic == 1].sum() + 0.5) / (weight.sum() + 1) if len(toxic) else 0.5
    model = Model(float(np.log(share / (1 - share))))
    if not 0 < toxic.sum() < len(toxic):
        return model
    grams, counts, words, lengths, base = [], [], [], [], 0
    with np.errstate(over="ignore"):
        for chunk in _chunks(texts):
            _, one, again = np.unique(chunk.hashes, return_index=True, return_inverse=True)
            found, of = subwords(chunk, one)
            grams.append(found[np.argsort(of, kind="stable")])
            counts.append(np.bincount(of, minlength=len(one)))
            stretch, word = _different(chunk.document_of(), again)
            words.append((word + base).astype(np.int32))
            lengths.append(np.bincount(stretch, minlength=chunk.documents))
            base += len(one)
    grams, counts, words, lengths = (np.concatenate(x) for x in (grams, counts, words, lengths))
    gram_at, word_at = np.cumsum(counts) - counts, np.cumsum(lengths) - lengths
    seen = _documents_of(grams, gram_at, counts, words, word_at, lengths, owner)
    common = seen >= LEAST
    pace = np.where(common, np.log(len(toxic) / np.maximum(seen, 1)) ** 2, 0)
    random = np.random.default_rng(seed)
    apart = random.permutation(len(toxic)) % APART == 0
    vectors = random.uniform(-0.01, 0.01, (BUCKETS, WIDTH)).astype(np.float32) * common[:, None]
    columns = np.array([[-0.5], [0.5]]) * random.choice([-1, 1], WIDTH) / np.sqrt(WIDTH)
    bias = np.array([0.0, model.bias])
    weight = weight / weight.mean()

    def scores() -> np.ndarray:
        numbers = vectors @ (columns[1] - columns[0]).astype(np.float32)
        value = np.add.reduceat(numbers[grams], gram_at) / counts
        return np.add.reduceat(value[words], word_at) / (lengths + FILL)

    rounds = max(ROUNDS, min(MOST_ROUNDS, VISITS // len(toxic)))
    steps, step = rounds * -(-(~apart).sum() // BATCH), 0

    for turn in range(rounds):
        worst = random.random(len(owner)) if turn == 0 else scores()
        order = np.lexsort((worst, owner))
        last = order[np.append(owner[order][1:] != owner[order][:-1], True)]  # of each document its worst stretch
        last = random.permutation(last[~apart[owner[last]]])
        for at in range(0, len(last), BATCH):
            rows = last[at: at + BATCH]
            w, row = _ragged(word_at[rows], lengths[rows])
            w = words[w]
            g, word = _ragged(gram_at[w], counts[w])
            g, row_of = grams[g], row[word]
            share = (SCALE / ((lengths[rows] + FILL)[row] * counts[w]))[word]
            starts = np.searchsorted(row_of, np.arange(len(rows)))
            inner = np.add.reduceat(vectors[g] * share[:, None].astype(np.float32), starts)
            logits = inner @ columns.T + bias
            p = np.exp(logits - logits.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            slope = p.copy()
            slope[np.arange(len(rows)), toxic[owner[rows]]] -= 1
            slope *= weight[owner[rows]][:, None]
            rate = RATE * (1 - step / steps)
            step += 1
            # The two slopes of a document are opposite, so all its vectors move in one direction.
            amount = np.bincount(g, share * slope[row_of, 1], BUCKETS) * pace
            touched = np.flatnonzero(amount)
            change = amount[touched, None] * (columns[1] - columns[0])
            columns -= rate * slope.T @ inner / len(rows)
            bias -= rate * slope.sum(axis=0) / len(rows)
            vectors[touched] -= (rate * change).astype(np.float32)
    model.bias = float(bias[1] - bias[0])
    model.weights = vectors @ (columns[1] - columns[0]).astype(np.float32)
    worst = np.full(len(toxic), -np.inf)
    np.maximum.at(worst, owner, SCALE * scores())
    if min(toxic[apart].sum(), (1 - toxic[apart]).sum()) >= ENOUGH:
        slope, shift = _line(worst[apart] + model.bias, toxic[apart], weight[apart])
        model.bias, model.weights = slope * model.bias + shift, np.float32(slope) * model.weights
    return model


def _line(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """The line that makes logits ``x`` fit labels ``y``, by Newton steps; labels count a little less than sure."""
    y = np.where(y == 1, 1 - 1 / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
    a = np.stack([x, np.ones(len(x))], axis=1)
    line = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ line, -30, 30)))
        h = (a * (weight * p * (1 - p))[:, None]).T @ a + np.eye(2) * 1e-3
        line = line + np.clip(np.linalg.solve(h, a.T @ (weight * (y - p)) - 1e-3 * (line - [1.0, 0.0])), -1, 1)
    return max(float(line[0]), 0.05), float(line[1])


def _documents_of(grams, gram_at, counts, words, word_at, lengths, owner) -> np.ndarray:
    """In how many documents each bucket occurs."""
    out = np.zeros(BUCKETS, np.int64)
    edge = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
    for a, b in zip(edge, np.append(edge[1:], len(owner)), strict=True):
        of = words[word_at[a]: word_at[b - 1] + lengths[b - 1]]
        out[np.unique(grams[_ragged(gram_at[of], counts[of])[0]])] += 1
    return out


def _ragged(begins: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of stretches of an array, one after another, and the stretch of each."""
    of = np.repeat(np.arange(len(sizes)), sizes)
    return np.arange(len(of)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + begins[of], of


def held_out() -> Column:
    """Documents that are never learnt from: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model of ``labels.toxic``, from at most ``sample`` documents of each class that are not held out."""
    tk.bound_batches(docs.sparkSession)
    learnt = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out()).select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.col("toxic") > 0).cast("int").alias("toxic"))
    learnt = learnt.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    totals = {r["toxic"]: r["count"] for r in learnt.groupBy("toxic").count().collect()}
    clean, bad = (learnt.filter(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for c in (0, 1))
    chosen = F.broadcast(clean.unionByName(bad))  # the limits are its size bound
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(chosen, "doc_id")

    @tk.tidy
    def emit(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for chunk in tk.chunks(batch.column("text")):
                rows, parts = [], []
                for i in range(chunk.documents):
                    a, b = chunk.offsets[i], chunk.offsets[i + 1]
                    many = -(-(b - a) // STRETCH)
                    for k in np.unique(np.linspace(0, many - 1, min(many, STRETCHES)).astype(int)) if many else ():
                        first, last = a + (b - a) * k // many, a + (b - a) * (k + 1) // many - 1
                        rows.append(chunk.first + i)
                        parts.append(chunk.data[chunk.starts[first]: chunk.ends[last]].tobytes().decode())
                rows = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(rows), batch.column("toxic").take(rows), pa.array(parts, pa.string())],
                    ["doc_id", "toxic", "part"])

    found = texts.mapInArrow(emit, "doc_id long, toxic int, part string").toArrow()
    found = found.sort_by([("doc_id", "ascending"), ("part", "ascending")]).combine_chunks()  # whatever the order of arrival
    ids, owner = np.unique(found["doc_id"].to_numpy(), return_inverse=True)
    toxic = np.zeros(len(ids), np.int64)
    toxic[owner] = found["toxic"].to_numpy()
    count = np.bincount(toxic, minlength=2)
    weight = np.array([totals.get(c, 0) / max(count[c], 1) for c in (0, 1)])
    parts = found["part"].chunk(0) if found.num_rows else pa.array([], pa.string())
    return fit(parts, owner, toxic, weight[toxic])


def scored(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """``docs`` with a score between 0 and 1 in a new column ``name``."""
    if name in docs.columns:
        raise ValueError(f"the documents have a column {name} already")
    tk.bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @tk.tidy
    def emit(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            score = pa.array(shared.value.score(batch.column("text")))
            yield pa.RecordBatch.from_arrays([*batch.columns, score], [*batch.schema.names, name])

    return docs.mapInArrow(emit, StructType([*docs.schema, StructField(name, DoubleType())]))


def toxic(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted (1 from ``threshold`` on) of every document."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held_out().alias("held_out"))
    return scored(rows, model).select(
        "doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
