"""Language identification by interpolated Kneser-Ney character models (operator 9).

Texts are lower-cased; every stretch of other characters than letters counts as one blank. For
each language the counts of all stretches of ``ORDER`` characters are gathered over all documents
that may be learnt from; lower orders use continuation counts, each order its own discount. The
models are stored as sorted arrays of packed n-grams with one column of log-probabilities per
language. A text gets the language with the smallest cross-entropy per character.

Confidence is calibrated on all documents that may be learnt from, each half with counts of the other
half alone: an isotonic fit of "right" on the margin between the two best languages, and per language
the largest usual cross-entropy, beyond which a prediction is marked as rejected. Both are fitted on
counts per step of 1 / ``STEPS``, so what reaches the driver does not grow with the documents.

Every n-gram of the corpus stays in the model. What a task holds is bounded all the same: where the
tables have more than ``CELLS`` entries they are cut by the last character but one, which n-grams,
their suffixes and their contexts share, and texts are read once per part, each pass adding the
logarithms of its n-grams.

Defined results: ``und`` with score 0 for a null text, a text without a letter, or when nothing
could be learnt; texts are read whole; ties go to the language that sorts first; a null doc_id is
not held out and not learnt from; rows without lang are not learnt from; repeated rows score
alike; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, LongType, StructField, StructType

from noticelake.llm import tokens as tk
from noticelake.llm.quality import held_out
from noticelake.llm.repeats import stored

ORDER = 4
#: Entries (n-grams times languages) of all orders together that a pass holds, and passes at most.
CELLS = 16_000_000
PASSES = 1_024
#: Steps of a margin or a cross-entropy between two whole numbers.
STEPS = 1_024
#: Share of calibration documents of a language whose cross-entropy counts as usual.
USUAL = 0.999
UNKNOWN = "und"
CHUNK = 400_000
_U = np.uint64
_LETTER = np.fromiter((chr(c).isalpha() for c in range(1 << 16)), bool, 1 << 16)


def symbols(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Letters as 16-bit codes with single zeros between, and where each text begins.

    Each text starts with the blank before it and ends with the blank behind it; letters outside
    the 16-bit range share codes of the private area.
    """
    lowered = [f" {t.lower()} " if t else "  " for t in texts]
    x = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
    wide = x > 0xFFFF
    codes = np.where(wide, 0, x).astype(np.uint16)
    codes[~_LETTER[codes]] = 0
    if wide.any():
        values, where = np.unique(x[wide], return_inverse=True)
        letters = np.fromiter((chr(v).isalpha() for v in values), bool, len(values))
        codes[wide] = np.where(letters, 0xE000 + values % 0x1900, 0)[where]
    size = np.fromiter(map(len, lowered), np.int64, len(lowered))
    begins = np.cumsum(size) - size
    keep = codes != 0
    keep[1:] |= codes[:-1] != 0
    keep[begins] = True
    return codes[keep], np.cumsum(keep)[begins] - 1


def grams(codes: np.ndarray, begins: np.ndarray):
    """A packed n-gram for each character behind a text's first blank, and its text's number."""
    size = np.diff(np.append(begins, len(codes)))
    text = np.repeat(np.arange(len(begins)), size)
    inside = np.arange(len(codes)) - np.repeat(begins, size)
    packed = codes.astype(_U)
    for k in range(1, ORDER):
        before = np.zeros(len(codes), _U)
        before[k:] = codes[:-k]
        before[inside < k] = 0
        packed |= before << _U(16 * k)
    some = inside > 0
    return packed[some], text[some]


def _pieces(batch: pa.RecordBatch, column: str) -> Iterator[tuple[int, list[str | None]]]:
    """Texts of a batch in pieces of about ``CHUNK`` characters, whole texts at a time."""
    first, held, size = 0, [], 0
    for text in batch.column(column):
        held.append(text.as_py())
        size += len(held[-1] or "")
        if size >= CHUNK:
            yield first, held
            first, held, size = first + len(held), [], 0
    if held:
        yield first, held


@tk.tidy
def _count(batches: Iterator[pa.RecordBatch]):
    """Counts per language, summed over the whole task in sorted arrays."""
    held: dict[str, list] = {}

    def summed(parts):
        keys, where = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
        return keys, np.bincount(where, np.concatenate([n for _, n in parts])).astype(np.int64)

    def rows(lang):
        keys, n = summed(held.pop(lang))
        return pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(keys), pa.string()), pa.array(keys.view(np.int64)), pa.array(n)],
            ["lang", "g", "n"])

    for batch in batches:
        langs = batch.column("lang")
        for first, texts in _pieces(batch, "text"):
            packed, text = grams(*symbols(texts))
            codes = langs.slice(first, len(texts)).dictionary_encode()
            which = codes.indices.to_numpy()[text]
            for i, lang in enumerate(codes.dictionary.to_pylist()):
                parts = held.setdefault(lang, [])
                parts.append(np.unique(packed[which == i], return_counts=True))
                if len(parts) >= 16:
                    held[lang] = [summed(parts)]
                    if len(held[lang][0][0]) > 1_000_000:
                        yield rows(lang)
    for lang in list(held):
        yield rows(lang)


@dataclass
class Models:
    languages: list[str]
    floor: float = 0.0
    keys: list[np.ndarray] = field(default_factory=list)  # per order, from 1
    logs: list[np.ndarray] = field(default_factory=list)
    contexts: list[np.ndarray] = field(default_factory=list)
    gammas: list[np.ndarray] = field(default_factory=list)
    margins: np.ndarray = field(default_factory=lambda: np.zeros(0))
    right: np.ndarray = field(default_factory=lambda: np.zeros(0))
    usual: np.ndarray = field(default_factory=lambda: np.zeros(0))
    part: int = 0
    parts: int = 1
    #: Makes the model of another part; stays on the driver.
    of: Callable[[int], Models] | None = None

    def __getstate__(self):
        return {**self.__dict__, "of": None}

    def log_probability(self, order: int, packed: np.ndarray) -> np.ndarray:
        """One column per language, backing off where an n-gram is not stored."""
        if not order:
            return np.full((len(packed), len(self.languages)), self.floor, np.float32)
        g = packed & _U((1 << 16 * order) - 1)
        at, hit = _find(self.keys[order - 1], g)
        out = self.logs[order - 1][at] if len(self.keys[order - 1]) else np.zeros(
            (len(g), len(self.languages)), np.float32)
        miss = np.flatnonzero(~hit)
        if len(miss):
            out[miss] = self._weight(order, g[miss] >> _U(16)) + self.log_probability(order - 1, g[miss])
        return out

    def _weight(self, order: int, context: np.ndarray) -> np.ndarray:
        at, hit = _find(self.contexts[order - 1], context)
        out = np.zeros((len(context), len(self.languages)), np.float32)
        out[hit] = self.gammas[order - 1][at[hit]]
        return out

    def sums(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sums of this part's logarithms per language, the number of all characters, and whether a
        text has a letter."""
        codes, begins = symbols(texts)
        packed, text = grams(codes, begins)
        n = np.bincount(text, minlength=len(texts))
        letters = np.bincount(text, packed & _U(0xFFFF) != 0, len(texts)) > 0
        if self.parts > 1:
            mine = _part_of(packed >> _U(16) & _U(0xFFFF), self.parts) == self.part
            packed, text = packed[mine], text[mine]
        out = np.zeros((len(texts), len(self.languages)))
        held = np.bincount(text, minlength=len(texts))
        some = np.flatnonzero(held)
        if len(some) and self.languages:
            at = (np.cumsum(held) - held)[some]
            out[some] = np.add.reduceat(self.log_probability(ORDER, packed), at, axis=0, dtype=np.float64)
        return out, n, letters

    def predict(self, sums: np.ndarray, n: np.ndarray, letters: np.ndarray):
        """The best language of each text from the sums of all parts."""
        entropy = -sums / np.maximum(n, 1)[:, None]
        rows = np.arange(len(n))
        best = entropy.argmin(axis=1)
        lowest = entropy[rows, best]
        rest = entropy.copy()
        rest[rows, best] = np.inf
        margin = np.minimum(rest.min(axis=1), lowest + 99.0) - lowest
        score = np.interp(margin, self.margins, self.right) if len(self.margins) else np.full(len(n), 0.5)
        limit = self.usual[best] if len(self.usual) else np.inf
        return best, lowest, margin, score, letters & (lowest <= limit)


def _part_of(character: np.ndarray, parts: int) -> np.ndarray:
    return (character * _U(40503) >> _U(4)) & _U(parts - 1)


def _cut(column: str, shift: int, parts: int):
    """The part of an n-gram whose character that decides stands ``shift`` bits from the right."""
    character = F.shiftrightunsigned(column, shift).bitwiseAND(F.lit(0xFFFF))
    return F.shiftright(character * F.lit(40503), 4).bitwiseAND(F.lit(parts - 1))


def _find(keys: np.ndarray, wanted: np.ndarray):
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.searchsorted(keys, wanted)
    at[at == len(keys)] = 0
    return at, keys[at] == wanted


def _matrix(table: pa.Table, value: str, languages: list[str], empty: float):
    """Sorted keys and a matrix key x language of ``value``."""
    g = table["g"].to_numpy().view(_U)
    keys, row = np.unique(g, return_inverse=True)
    column = np.searchsorted(languages, table["lang"].to_numpy(zero_copy_only=False).astype(str))
    out = np.full((len(keys), len(languages)), empty)
    out[row, column] = table[value].to_numpy()
    return keys, out


def train(docs: DataFrame) -> Models:
    """Models of all languages in all documents that are not held out.

    The score is calibrated on the same documents, each judged by models that know the other half.
    """
    tk.bound_batches(docs.sparkSession)
    learnt = docs.filter("lang IS NOT NULL AND text IS NOT NULL AND doc_id IS NOT NULL").filter(~held_out())
    half = F.crc32(F.col("doc_id").cast("string")) % 2

    def summed(counts: DataFrame) -> DataFrame:
        return stored(counts.groupBy("lang", "g").agg(F.sum("n").alias("n")), "grams")

    halves = [learnt.filter(half == i).select("lang", "text") for i in (0, 1)]
    counts = [summed(x.mapInArrow(_count, "lang string, g long, n long")) for x in halves]
    models = _models(summed(counts[0].unionByName(counts[1])))
    others = [_models(c) for c in reversed(counts)]
    judged = [_judged(m, x) for m, x in zip(others, halves, strict=True) if m.languages]
    if judged:
        _calibrate(models, stored(reduce(DataFrame.unionByName, judged), "judged"))
    return models


def _models(level: DataFrame) -> Models:
    """Models from the counts (lang, g, n) of the highest order; of several parts the first."""
    levels = [level]
    for order in range(ORDER - 1, 0, -1):
        lower = F.col("g").bitwiseAND(F.lit((1 << 16 * order) - 1))
        level = stored(level.groupBy("lang", lower.alias("g")).agg(F.count("*").alias("n")), "grams")
        levels.insert(0, level)
    languages = levels[0].select("lang").distinct().orderBy("lang").toArrow()["lang"].to_pylist()
    if not languages:
        return Models(languages)
    symbols_seen = max(1, levels[0].select("g").distinct().count())
    sums = []
    for level in levels:
        # Sums over a language; the discount of its order is n1 / (n1 + 2 n2).
        one = level.groupBy("lang").agg(
            F.sum("n").alias("total"), F.sum((F.col("n") == 1).cast("long")).alias("n1"),
            F.sum((F.col("n") == 2).cast("long")).alias("n2"))
        sums.append(stored(one.select("lang", F.when(
            F.col("n1") > 0, F.col("n1") / (F.col("n1") + 2 * F.col("n2"))).otherwise(0.5).alias("d")), "discounts"))
    character = F.shiftrightunsigned("g", 16).bitwiseAND(F.lit(0xFFFF)).cast("long").alias("c")
    sizes = reduce(DataFrame.unionByName, [x.select("g", character).distinct() for x in levels[1:]]).groupBy("c").count().toArrow()
    at, size = sizes["c"].to_numpy().astype(np.uint64), sizes["count"].to_numpy() * len(languages)
    parts = 1
    while parts < PASSES and np.bincount(_part_of(at, parts).astype(np.int64), size).max(initial=0) > CELLS:
        parts *= 2

    def of(part: int) -> Models:
        models = Models(languages, float(-np.log(symbols_seen + 1)), part=part, parts=parts)
        for order, (level, one) in enumerate(zip(levels, sums, strict=True), 1):
            if parts > 1 and order > 1:
                level = level.filter(_cut("g", 16, parts) == part)
            context = F.shiftrightunsigned("g", 16)
            contexts = level.groupBy("lang", context.alias("g")).agg(
                F.sum("n").alias("sum"), F.count("*").alias("kinds")).join(one, "lang").select(
                "lang", "g", "sum", "d", (F.col("d") * F.col("kinds") / F.col("sum")).alias("w"))
            kept = level.select("lang", F.col("g").alias("gram"), context.alias("g"), "n").join(contexts, ["lang", "g"]).select(
                "lang", F.col("gram").alias("g"),
                (F.greatest(F.col("n") - F.col("d"), F.lit(0.0)) / F.col("sum")).alias("p"))
            keys, direct = _matrix(kept.toArrow(), "p", languages, 0.0)
            contexts_at, weights = _matrix(contexts.select("lang", "g", "w").toArrow(), "w", languages, 1.0)
            models.contexts.append(contexts_at)
            models.gammas.append(np.log(np.maximum(weights, 1e-12)).astype(np.float32))
            models.keys.append(keys)
            models.logs.append(np.zeros((len(keys), len(languages)), np.float32))
            lower = models._weight(order, keys >> _U(16)) + models.log_probability(order - 1, keys)
            models.logs[-1] = np.log(direct + np.exp(lower)).astype(np.float32)
        return models

    first = of(0)
    first.of = of
    return first


def _summed(docs: DataFrame, models: Models) -> DataFrame:
    """``docs`` (text and more) with ``sums``, ``n`` and ``letters``; a pass over the texts per part."""
    tk.bound_batches(docs.sparkSession)
    names = docs.columns
    schema = StructType([*docs.schema, StructField("sums", ArrayType(DoubleType())), StructField("n", LongType()),
                         StructField("letters", BooleanType())])

    def adding(shared):
        @tk.tidy
        def emit(batches: Iterator[pa.RecordBatch]):
            for batch in batches:
                for first, texts in _pieces(batch, "text"):
                    rows = batch.slice(first, len(texts))
                    found, n, letters = shared.value.sums(texts)
                    if "sums" in batch.schema.names:
                        found = found + rows.column("sums").flatten().to_numpy().reshape(found.shape)
                    at = pa.array((np.arange(len(texts) + 1) * found.shape[1]).astype(np.int32))
                    yield pa.RecordBatch.from_arrays([
                        *(rows.column(c) for c in names), pa.ListArray.from_arrays(at, pa.array(found.ravel())),
                        pa.array(n.astype(np.int64)), pa.array(letters)], schema.names)

        return emit

    rows = docs
    for part in range(models.parts):
        shared = docs.sparkSession.sparkContext.broadcast(models if part == models.part else models.of(part))
        rows = rows.mapInArrow(adding(shared), schema)
        if part + 1 < models.parts:
            rows = stored(rows, "sums")
            shared.destroy()
    return rows


def _of(batch: pa.RecordBatch, languages: int):
    sums = batch.column("sums").flatten().to_numpy().reshape(batch.num_rows, languages)
    return sums, batch.column("n").to_numpy(), batch.column("letters").to_numpy(zero_copy_only=False)


def _judged(models: Models, docs: DataFrame) -> DataFrame:
    """The prediction for each of ``docs`` (lang, text) that has a letter: its language, cross-entropy
    and margin, and whether it is right."""
    names = np.array(models.languages)

    def emit(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            sums, n, letters = _of(batch, len(names))
            best, lowest, margin, _, _ = Models(list(names)).predict(sums, n, letters)
            right = names[best] == np.array(batch.column("lang").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [pa.array(names[best[letters]], pa.string()), pa.array(lowest[letters]),
                 pa.array(margin[letters]), pa.array(right[letters])],
                ["best", "lowest", "margin", "right"])

    return _summed(docs.select("lang", "text"), models).drop("text").mapInArrow(
        emit, "best string, lowest double, margin double, right boolean")


def _calibrate(models: Models, judged: DataFrame) -> None:
    def step(column: str):
        return F.floor(F.col(column) * STEPS).alias("at")

    entropy = judged.groupBy("best", step("lowest")).agg(F.count("*").alias("n")).orderBy("best", "at").toArrow()
    best = np.array(entropy["best"].to_pylist())
    at, n = (entropy[c].to_numpy() for c in ("at", "n"))
    limits = {}
    for name in np.unique(best):
        mine = best == name
        share = np.cumsum(n[mine]) / n[mine].sum()
        limits[name] = (at[mine][np.searchsorted(share, USUAL)] + 1) / STEPS * 1.05
    models.usual = np.array([limits.get(x, np.inf) for x in models.languages])
    margin = judged.groupBy(step("margin")).agg(
        F.count("*").alias("n"), F.count_if("right").alias("right")).orderBy("at").toArrow()
    at, n, right = (margin[c].to_numpy() for c in ("at", "n", "right"))
    models.margins, models.right = _isotonic((at + 0.5) / STEPS, right, n)


def _isotonic(x: np.ndarray, right: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rising steps through ``right`` of ``n`` cases at each x, each step with one right and one wrong case added."""
    total = int(n.sum())
    wanted = max(1, min(50, total // 20))
    block = (np.cumsum(n) - n) * wanted // max(1, total)
    blocks: list[list[float]] = []
    for i in np.unique(block):
        part = block == i
        size = n[part].sum()
        blocks.append([(x[part] * n[part]).sum() / size, right[part].sum() + 1, size + 2])
        while len(blocks) > 1 and blocks[-2][1] / blocks[-2][2] > blocks[-1][1] / blocks[-1][2]:
            b = blocks.pop()
            a = blocks[-1]
            both = a[2] + b[2]
            blocks[-1] = [(a[0] * a[2] + b[0] * b[2]) / both, a[1] + b[1], both]
    return np.array([b[0] for b in blocks]), np.array([b[1] / b[2] for b in blocks])


def identify(docs: DataFrame, models: Models) -> DataFrame:
    """doc_id, held_out, lang_pred, score, the cross-entropy, and whether it is accepted."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text")
    names = np.array([*models.languages, UNKNOWN], dtype=object)
    judge = Models(models.languages, margins=models.margins, right=models.right, usual=models.usual)

    def emit(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            if len(names) > 1:
                sums, n, letters = _of(batch, len(names) - 1)
                best, lowest, _, score, accepted = judge.predict(sums, n, letters)
                best = np.where(letters, best, len(names) - 1)
                score = np.where(letters, np.clip(score, 0, 1), 0.0)
            else:
                best, score = np.zeros(batch.num_rows, int), np.zeros(batch.num_rows)
                lowest, accepted = score, np.zeros(batch.num_rows, bool)
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), batch.column("held_out"),
                pa.array(names[best], pa.string()), pa.array(score), pa.array(lowest), pa.array(accepted),
            ], ["doc_id", "held_out", "lang_pred", "score", "cross_entropy", "accepted"])

    return _summed(rows, models).drop("text").mapInArrow(
        emit, "doc_id long, held_out boolean, lang_pred string, score double, cross_entropy double, accepted boolean")
