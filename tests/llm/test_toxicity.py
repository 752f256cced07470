"""The toxicity model: held-out accuracy, misspellings, and scores that depend on one text alone."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType
from samples import prose

from noticelake.llm import tokens as tk
from noticelake.llm import toxicity

INSULTS = ["blockhead", "nincompoop", "rapscallion", "scoundrel"]
LABELS = "doc_id long, quality int, toxic int"


def document(i: int) -> tuple[str, int]:
    """Every third document holds an insult with another ending in each."""
    r = random.Random(i)
    words = prose(i, r.choice([15, 60, 300])).split()
    bad = int(i % 3 == 0)
    if bad:
        for _ in range(max(1, len(words) // 50)):
            words.insert(r.randrange(len(words)), r.choice(INSULTS) + r.choice(["", "s", "ish", "ery", "ing", ","]))
    return " ".join(words), bad


@pytest.fixture(scope="module")
def model():
    rows = [document(i) for i in range(2400)]
    parts, owner = [], []
    for i, (text, _) in enumerate(rows):
        words = text.split()
        for a in range(0, len(words), toxicity.STRETCH):
            parts.append(" ".join(words[a: a + toxicity.STRETCH]))
            owner.append(i)
    bad = np.array([b for _, b in rows])
    return toxicity.fit(pa.array(parts), np.array(owner), bad, np.ones(len(bad)))


def test_held_out_documents(model):
    rows = [document(i) for i in range(10_000, 10_600)]
    predicted = model.score(pa.array([t for t, _ in rows])) >= toxicity.THRESHOLD
    bad = np.array([b for _, b in rows]) == 1
    assert (predicted & bad).sum() >= 0.85 * bad.sum() and (predicted & ~bad).sum() <= 0.03 * (~bad).sum()


def test_unseen_misspellings(model):
    texts = [f"{prose(s, 12)} {w} {prose(s + 1, 12)}" for s, w in enumerate(
        ["blockheadz", "BLOCKHEAD", "nincompoooop", "rapscallionlike", "scoundrell", "“scoundrel”"])]
    assert (model.score(pa.array(texts)) >= toxicity.THRESHOLD).all()


def test_few_words_in_a_long_text(model):
    clean = prose(5, 40_000)
    words = clean.split()
    words[31_000:31_000] = ["blockhead", "and", "scoundrel"]
    score = model.score(pa.array([clean, " ".join(words)]))
    assert score[0] < toxicity.THRESHOLD <= score[1]


def test_a_score_depends_on_its_text_alone(model):
    texts = [None, "", " \n\t", "x", "é", "\n" * 400 + "blockhead", "a" * 70_000, "\U0001f600 " * 300, "\x00\x1c"]
    texts += [document(i)[0] for i in range(200)]
    alone = [model.score(pa.array([t], pa.string()))[0] for t in texts]
    assert model.score(pa.array(texts, pa.string())).tolist() == alone
    assert model.score(pa.array(texts[::-1], pa.string())).tolist() == alone[::-1]
    assert alone[0] == alone[1] == alone[2] == 1 / (1 + np.exp(-model.bias)) and np.isfinite(alone).all()


def test_subwords_by_hand():
    """Every n-gram inside a word once, with marks at its ends, and the word itself."""
    words = ["étés", "abcdef", "ab", "abcdef"]
    chunk = next(tk.chunks(pa.array([" ".join(words)])))
    found, owner = toxicity.subwords(chunk, np.arange(4))
    count = [1 + sum(max(0, len(w) - n + 1) for n in toxicity.SIZES) for w in words]
    assert np.bincount(owner).tolist() == count
    bags = [sorted(found[owner == i].tolist()) for i in range(4)]
    assert bags[1] == bags[3] and len(set(bags[0]) & set(bags[1])) == 0
    longer = next(tk.chunks(pa.array(["abcdefg"])))
    begins = set(toxicity.subwords(longer, np.arange(1))[0].tolist())
    assert len(begins & set(bags[1])) == sum(6 - n for n in toxicity.SIZES)  # all but those at the end of "abcdef"


def test_queries_frame(spark):
    ids = list(range(400))
    docs = spark.createDataFrame(
        [(i, document(i)[0], 1) for i in ids] + [(None, "scoundrel", 1), (900, None, 1), (901, "", 1), (1, document(1)[0], 1)],
        "doc_id long, text string, toxic int")
    labels = spark.createDataFrame(
        [(i, None, document(i)[1]) for i in ids] + [(None, 1, 1), (5, 1, None), (7777, 0, 1)], LABELS)
    model = toxicity.train(docs, labels)
    got = toxicity.toxic(docs, model).collect()
    assert len(got) == 404 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got)
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    assert len({r["score"] for r in got if r["doc_id"] == 1}) == 1 and sum(r["doc_id"] == 1 for r in got) == 2
    again = toxicity.train(docs.repartition(5), labels.repartition(3))
    assert again.bias == model.bias and (again.weights == model.weights).all()
    held = labels.filter(toxicity.held_out())
    assert (toxicity.train(docs, labels.subtract(held)).weights == model.weights).all()


def test_nothing_to_learn(spark):
    schema = StructType([StructField("doc_id", LongType()), StructField("text", StringType()), StructField("score", IntegerType())])
    docs = spark.createDataFrame([(1, "a b", 3), (2, None, None)], schema)
    none = spark.createDataFrame([], LABELS)
    model = toxicity.train(docs, none)
    assert [r["score"] for r in toxicity.toxic(docs, model).collect()] == [0.5, 0.5]
    one = toxicity.train(docs, spark.createDataFrame([(3, 1, 1), (4, 1, 1), (5, 1, 1)], LABELS))
    assert toxicity.toxic(docs.limit(0), one).collect() == []
    with pytest.raises(ValueError, match="score"):
        toxicity.scored(docs, model)
