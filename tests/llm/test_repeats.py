"""Operators 3 and 8 against all windows of all documents."""

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import samples
from hypothesis import given, settings
from hypothesis import strategies as st

from noticelake.llm import recompression, repeats, suffixes
from noticelake.llm import tokens as tk
from noticelake.llm.bitmaps import bitmap_of, maybe_in


def test_substring_dedup(spark):
    got = Counter(tuple(r) for r in recompression.dedup_substrings(samples.frame(spark)).collect())
    marks = samples.covered(samples.rows(), 20)
    want = Counter()
    for r in samples.rows():
        mark, words = marks[r[0], r[1] or ""], samples.WORD.findall(r[1] or "")
        kept = " ".join(w for w, m in zip(words, mark, strict=True) if not m)
        want[r[0], len(words), sum(mark), hashlib.sha256(kept.encode()).hexdigest()] += 1
    assert got == want


def test_suffix_dedup(spark):
    got: dict = {}
    for r in suffixes.repeated_spans(samples.frame(spark)).collect():
        got.setdefault(r.doc_id, set()).update(range(r.start, r.end))
        assert r.first_doc_id <= r.doc_id
    marks = samples.covered(samples.rows(), 50)
    want = {i: {p for p, m in enumerate(mark) if m} for (i, _), mark in marks.items() if i is not None and any(mark)}
    assert {i: v for i, v in got.items() if i >= 0} == want


def test_cut_texts(spark):
    docs = samples.frame(spark)
    cut = suffixes.remove_repeats(docs)
    assert cut.schema == docs.schema and cut.count() == docs.count()
    texts = {(r.doc_id, r.spans): r.text for r in cut.collect() if r.doc_id is not None}
    marks = samples.covered(samples.rows(), 50)
    for (i, t), mark in marks.items():
        if i is not None:
            kept = [w for w, m in zip(samples.WORD.findall(t), mark, strict=True) if not m]
            assert samples.WORD.findall(texts[i, "x"] or "") == kept
    assert texts[6, "x"] is None and texts[0, "x"] == samples.rows()[0][1]


def test_empty_tables(spark):
    empty = samples.frame(spark, [])
    assert recompression.dedup_substrings(empty).count() == 0
    assert suffixes.repeated_spans(empty).count() == 0
    assert suffixes.remove_repeats(empty).count() == 0


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_given_documents(spark, sf):
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    data = [(r.doc_id, r.text) for r in docs.collect()]
    marks = samples.covered(data, 20)
    got = {r.doc_id: r.n_removed for r in recompression.dedup_substrings(docs).collect()}
    assert got == {i: sum(m) for (i, _), m in marks.items()}


@given(st.lists(st.lists(st.sampled_from("abcd"), max_size=70), min_size=2, max_size=4))
@settings(max_examples=150, deadline=None)
def test_equal_windows_have_equal_anchors(texts):
    """Whatever stands around a window, its anchor has one name and one place in it."""
    with np.errstate(over="ignore"):
        chunk = next(tk.chunks(pa.array([" ".join(t) for t in texts])))
        for anchors, length in ((recompression.symbols, 20), (suffixes.minimisers, 20)):
            ends = np.repeat(chunk.offsets[1:], np.diff(chunk.offsets))
            starts = np.flatnonzero(np.arange(len(ends)) + length <= ends)
            if not len(starts):
                continue
            _, names = anchors(chunk.hashes, starts, length)
            seen: dict = {}
            for s, name in zip(starts, names, strict=True):
                window = tuple(chunk.hashes[s: s + length])
                assert seen.setdefault(window, name) == name


def test_words_of_buffers():
    texts = ["a  b\tc", None, "", "\x0bÄ\x85x\xa0y z\r", "tail"]
    chunk = next(tk.chunks(pa.array(texts).slice(0, 5)))
    words = [bytes(chunk.data[a:b]).decode() for a, b in zip(chunk.starts, chunk.ends, strict=True)]
    assert words == ["a", "b", "c", "Ä\x85x\xa0y", "z", "tail"]
    assert chunk.offsets.tolist() == [0, 3, 3, 3, 5, 6]
    again = next(tk.chunks(pa.array(["z tail"])))
    assert again.hashes.tolist() == chunk.hashes[-2:].tolist()


def test_small_chunks_are_the_same():
    texts = pa.array([r[1] for r in samples.rows()])
    whole = np.concatenate([c.hashes for c in tk.chunks(texts)])
    parts = np.concatenate([c.hashes for c in tk.chunks(texts, limit=100)])
    assert (whole == parts).all()


def test_bitmap(spark):
    values = [5, 77, -3, 1 << 40]
    bitmap = bitmap_of(spark.createDataFrame([(v,) for v in values], "a long"), "a")
    assert maybe_in(bitmap, np.array(values)).all() and not maybe_in(bitmap, np.array([6, 1 << 41 | 9])).any()


def test_sources_of_suffix_dedup(spark):
    """Every window of a stretch names the first document that has it, through copies of copies."""
    p, q, r = (samples.prose(2000 + i, 400 + 60 * i) for i in range(3))
    texts = [p, q, f"{samples.prose(2010, 60)} {p} {q} {samples.prose(2011, 70)}", f"{q} {r}", f"{r} {p}",
             " ".join(p.split()[100:260] + q.split()[:90]), f"{p} {q} {samples.prose(2012, 30)}",
             f"{samples.prose(2010, 60)} {p} {q} {samples.prose(2011, 70)}", f"{samples.prose(2013, 80)} " * 2,
             " ".join(q.split()[50:300] + samples.prose(2013, 80).split())]
    data = [(i, t, *samples.rows()[0][2:]) for i, t in enumerate(texts)] + [r for r in samples.rows() if (r[0] or 0) > 10]
    data = [(i, *r[1:]) for i, r in enumerate(data)]
    first, want = {}, {}
    for i, text, *_ in data:
        words = samples.WORD.findall(text or "")
        for s in range(len(words) - 49):
            w = tuple(words[s: s + 50])
            if w in first:
                want[i, s] = first[w]
            first.setdefault(w, i)
    got = {}
    for row in suffixes.repeated_spans(samples.frame(spark, data)).collect():
        assert row.first_doc_id == min(x.doc_id for x in row.sources)
        assert (row.start, row.end) == (min(x.start for x in row.sources), max(x.end for x in row.sources))
        got |= {(row.doc_id, s): x.doc_id for x in row.sources for s in range(x.start, x.end - 49)}
    assert got == want and len(set(want.values())) > 5


def test_copies_of_common_runs_are_not_joined(spark):
    """Documents with one passage in common: its runs are looked up, and adjacent ones make one row."""
    passage = " ".join(f"shared{i}" for i in range(400))
    rows = [(i, f"{' '.join(f'own{i}x{j}' for j in range(60))} {passage} end{i}") for i in range(40)]
    rows += [(100, passage), (101, passage), (102, None), (103, "")]
    docs = spark.createDataFrame(rows, "_key long, text string")

    def spans(runs):
        return {(r["_key"], *x) for r in repeats.word_spans(runs, 50).collect() for x in r["_spans"]}

    joined = repeats.repeated_runs(docs, 50, suffixes.minimisers, common=10**6)
    want = spans(joined)
    assert want == {(i, 60, 460) for i in range(1, 40)} | {(100, 0, 400), (101, 0, 400)}
    # All common runs in the table, one of them, and none but those with nearly all documents.
    for least, most in ((2, 1000), (2, 1), (40, 1000)):
        found = repeats.repeated_runs(docs, 50, suffixes.minimisers, common=least, most_common=most)
        assert spans(found) == want
        assert found.join(docs, found.k == docs["_key"]).filter("source >= k AND k <> 0").count() == 0
    looked_up = repeats.repeated_runs(docs, 50, suffixes.minimisers, common=2)
    assert looked_up.count() < joined.count()


def test_names_with_one_hash_are_joined(spark, monkeypatch):
    """Only one run per hash is in the table; the others take the join."""
    docs = samples.frame(spark).selectExpr("coalesce(doc_id, -1) AS _key", "text").groupBy("_key").agg({"text": "max"})
    docs = docs.toDF("_key", "text")
    want = sorted(repeats.word_spans(repeats.repeated_runs(docs, 20, recompression.symbols), 20).collect())
    monkeypatch.setattr(repeats, "_slots", lambda a, c, n: np.zeros(len(a), np.uint64))
    found = repeats.repeated_runs(docs, 20, recompression.symbols, common=2)
    assert sorted(repeats.word_spans(found, 20).collect()) == want
