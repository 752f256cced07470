"""Operator 5: an exact round trip through the tokenizer, and properties of the packing."""

import zlib
from collections import defaultdict
from functools import cache

import numpy as np
import pytest
import samples
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from noticelake.llm import packing


@cache
def word_ids():
    return packing.WordIds(packing.vocabulary_path())


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(packing.vocabulary_path())


ODD = ["á ́b", "İstanbul ΑΣ ΑΣ. ﬁ", "x<|endoftext|>y <|startoftext|>", "a\x1cb c d", "don't 123abc's 'S'll", "é́ ş̧ ß ẞ ŉ ĸ ſ ª º × ÷ Ñ",
       "a\x00b c\x7fd", "１２３ ①x ½", "한국어 日本 語", " ", "\xa0x", "--don't--", "5'm 'VE", "<<a>>"]


@given(st.one_of(st.text(max_size=40), st.sampled_from(ODD),
                 st.text("abß'ÄéIİs<|>endoftx \n19.,!", max_size=30)))
@settings(max_examples=400, deadline=None)
def test_words_have_the_ids_of_the_whole_text(text):
    words = word_ids()
    want = words.tokenizer.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(words.of(text.encode()), "<u4").tolist() == want


def test_odd_texts():
    words = word_ids()
    for text in ODD:
        want = words.tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(words.of(text.encode()), "<u4").tolist() == want


def check(rows, texts, tokenizer, capacity):
    by_document, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_document[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert set(by_document) == set(texts)
    for doc, pieces in by_document.items():
        ids = [*tokenizer.encode(texts[doc] or "", add_special_tokens=False).ids, 1]
        at = 0
        for r in sorted(pieces, key=lambda r: r.start):
            part = np.array(ids[r.start: r.start + r.length], "<u4")
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(part.tobytes())
            at += r.length
        assert at == len(ids)
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= capacity
    return by_sequence


def test_given_documents(spark, tokenizer):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").repartition(3)
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = packing.pack(docs).collect()
    sequences = check(rows, texts, tokenizer, packing.CAPACITY)
    sizes = [sum(r.length for r in s) for s in sequences.values()]
    padding = sum(packing.CAPACITY - n for n in sizes if n & (n - 1))
    assert padding / sum(sizes) < 0.02


def test_odd_rows(spark, tokenizer):
    data = [r for r in samples.rows() if r[0] is not None and r[0] != 15]
    docs = samples.frame(spark, data)
    rows = packing.pack(docs, capacity=64, windows=4, piece=16, with_ids=True).collect()
    check(rows, {r[0]: r[1] for r in data}, tokenizer, 64)
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in rows)
    whole = packing.pack(samples.frame(spark)).collect()
    assert sum(r.length for r in whole if r.doc_id == 15) == 2 * next(r for r in whole if r.doc_id == 15).doc_tokens
    assert any(r.doc_id is None for r in whole)
    assert packing.pack(samples.frame(spark, [])).count() == 0


@given(st.lists(st.integers(1, 100), max_size=60))
@settings(max_examples=200, deadline=None)
def test_windows_hold_everything_once(sizes):
    groups = packing.fill_windows(sizes, 100)
    assert sorted(i for g in groups for i in g) == list(range(len(sizes)))
    assert all(sum(sizes[i] for i in g) <= 100 for g in groups)


def test_differencing_balances():
    sizes = np.random.default_rng(3).integers(1, 500, 640).tolist()
    sums = [sum(sizes[i] for i in g) for g in packing.differencing(sizes, 32)]
    assert max(sums) - min(sums) < 0.03 * sum(sizes) / 32
    assert packing.differencing([8, 7, 6, 5, 4], 2) in ([[0, 3], [1, 2, 4]], [[1, 2, 4], [0, 3]]) or max(
        sum([8, 7, 6, 5, 4][i] for i in g) for g in packing.differencing([8, 7, 6, 5, 4], 2)) <= 16
