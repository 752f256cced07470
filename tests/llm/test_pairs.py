"""Operators 2 and 4 against brute force."""

import random

import pytest
import re

import numpy as np
import samples
from pyspark.sql import functions as F
import xxhash

from noticelake.llm import decontaminate, simhash, similar
from noticelake.llm.components import components


def fingerprint(text):
    words = samples.WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i: i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def smallest(points, linked):
    root = {p: p for p in points}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(points):
        for b in points[i + 1:]:
            if linked(a, b):
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {p: find(p) for p in points}


def test_near_duplicates(spark):
    data = samples.rows()
    got = sorted((r.id is None, r.id or 0, r.fp & (2**64 - 1), r.component)
                 for r in simhash.near_duplicates(samples.frame(spark)).collect())
    prints = [fingerprint(r[1]) for r in data]
    roots = smallest(sorted(set(prints)), lambda a, b: (a ^ b).bit_count() <= 4)
    least = {}
    for r, p in zip(data, prints, strict=True):
        if r[0] is not None:
            least[roots[p]] = min(r[0], least.get(roots[p], r[0]))
    want = sorted((r[0] is None, r[0] or 0, p, least.get(roots[p])) for r, p in zip(data, prints, strict=True))
    assert got == want


def test_one_of_each(spark):
    docs = samples.frame(spark)
    kept = simhash.one_of_each(docs)
    assert kept.schema == docs.schema
    ids = sorted(r.doc_id for r in kept.collect() if r.doc_id is not None)
    # 3, 4 and 5 follow the row without an id; the empty texts are one; 11 is 10; 15 stays once.
    assert not {3, 4, 7, 8, 11} & set(ids) and {0, 6, 10, 15} <= set(ids) and len(ids) == len(set(ids))
    assert simhash.one_of_each(samples.frame(spark, [])).count() == 0
    assert simhash.near_duplicates(samples.frame(spark, [])).count() == 0


def points_near(seed, centres, each, most):
    r = random.Random(seed)
    out = set()
    for _ in range(centres):
        c = r.getrandbits(64)
        for _ in range(each):
            out.add(c ^ sum({1 << r.randrange(64) for _ in range(r.randint(0, most))}))
    return sorted(out)


def test_no_link_is_lost(spark):
    """Dense and loose groups, whole or cut into blocks, for two numbers of segments."""
    points = points_near(3, 40, 12, 5) + points_near(4, 1, 400, 3)
    want = smallest(points, lambda a, b: (a ^ b).bit_count() <= 4)
    frame = spark.createDataFrame([(int(np.uint64(p).view(np.int64)),) for p in points], "fp long")
    for n, block in ((3, 50_000), (3, 20), (4, 50_000)):
        links = simhash.links(frame, n=n, block=block).collect()
        unsigned = [(r.u & (2**64 - 1), r.v & (2**64 - 1)) for r in links]
        assert all((a ^ b).bit_count() <= 4 for a, b in unsigned)
        root = {p: p for p in points}

        def find(x, root=root):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in unsigned:
            root[max(find(a), find(b))] = min(find(a), find(b))
        assert {p: find(p) for p in points} == want


def test_forest_of_a_large_anchor(monkeypatch):
    points = np.array(points_near(5, 3, 200, 4), np.uint64)
    home = np.arange(len(points)) % 3 == 0
    u, v = simhash._links_of(points, np.array([len(points)]), home, 4)
    monkeypatch.setattr(simhash, "AT_ONCE", 10)
    u2, v2 = simhash._links_of(points, np.array([len(points)]), home, 4)

    def groups(u, v):
        root = {int(p): int(p) for p in points}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in zip(u.tolist(), v.tolist(), strict=True):
            root[max(find(a), find(b))] = min(find(a), find(b))
        return [find(int(p)) for p in points]

    assert groups(u, v) == groups(u2, v2) and len(u2) < len(points)


def test_components_of_a_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(100, 160)]
    star = [(7, i) for i in range(1000, 1100)]
    links = spark.createDataFrame(chain + star + [(3, 3), (1000, 7)], "u long, v long")
    got = {r.node: r.root for r in components(links).collect()}
    assert got == {i: 100 for i in range(101, 161)} | {i: 7 for i in range(1000, 1100)} or {
        k: v for k, v in got.items() if k != v} == {i: 100 for i in range(101, 161)} | {i: 7 for i in range(1000, 1100)}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


BENCH = [
    (1, samples.prose(50, 40)), (2, samples.prose(51, 14)), (3, samples.prose(52, 8)), (4, "one two"), (5, None),
    (None, samples.prose(53, 30)), (6, samples.prose(50, 40)), (7, ""),
]


def leaky():
    item = {i: t for i, t in BENCH if i}
    changed = item[1].split()
    changed[5], changed[17], changed[30] = "other", "more", "last"
    far = item[1].split()
    for i in range(0, 40, 3):
        far[i] = "no"
    null = dict(BENCH)[None]
    texts = [
        (0, samples.prose(60, 200)), (1, f"{samples.prose(61, 30)} {item[1]}!"), (2, " ".join(changed)),
        (3, " ".join(far)), (4, f"X {item[2].upper()}, {samples.prose(62, 20)}"), (5, f"so {item[3]} it is"),
        (6, " ".join(item[3].split()[:7])), (7, "one two"), (8, None), (9, ""), (10, null), (None, item[1]),
    ]
    return [(i, t, None, None, None, "x", 1, "k", None, 1, 2) for i, t in texts]


def test_leaks(spark):
    docs = samples.frame(spark, leaky())
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    found = decontaminate.overlaps(docs, bench).collect()
    assert {r.doc_id for r in found} == {1, 2, 4, 5, 10, None}
    whole = next(r for r in found if r.doc_id == 1)
    assert (whole.item_id, whole.start, whole.end, whole.item_start) == (1, 30, 70, 0)
    assert {r.item_id for r in found if r.doc_id == 10} == {None}
    kept = decontaminate.without_leaks(docs, bench)
    assert kept.schema == docs.schema
    assert sorted(r.doc_id for r in kept.collect()) == [0, 3, 6, 7, 8, 9]


def test_leaks_in_blocks_and_empty_tables(spark, monkeypatch):
    docs = samples.frame(spark, leaky())
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    one = {r.doc_id for r in decontaminate.overlaps(docs, bench).collect()}
    monkeypatch.setattr(decontaminate, "BLOCK", 15)
    assert {r.doc_id for r in decontaminate.overlaps(docs, bench).collect()} == one
    monkeypatch.undo()
    nothing = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.overlaps(docs, nothing).count() == 0
    assert decontaminate.without_leaks(docs, nothing).count() == docs.count()
    assert decontaminate.overlaps(samples.frame(spark, []), bench).count() == 0


def test_two_substitutions_always_hit(spark):
    """Every way to change two tokens of a window leaves at least one mask untouched."""
    for a in range(12):
        for b in range(12):
            assert any(a not in m and b not in m for m in decontaminate.MASKS)


def jaccard(a, b):
    one, two = ({tuple(w[i: i + 5]) for i in range(max(1, len(w) - 4))} for w in (a.lower().split(), b.lower().split()))
    return len(one & two) / len(one | two)


def test_one_of_each_finds_copies_from_080_on(spark):
    """Copies with changed words, at 0.80 and above gone and below kept, single and in a large group."""
    texts, gone, r = [], set(), random.Random(9)
    for n in range(80):
        base = samples.prose(5000 + n, 120 + n)
        copy = base.split()
        while jaccard(base, " ".join(copy)) > 0.96 - n / 400:
            copy[r.randrange(len(copy))] = f"new{r.randrange(10**6)}"
        texts += [(2 * n, base), (2 * n + 1, " ".join(copy))]
        if jaccard(base, " ".join(copy)) >= 0.8:
            gone.add(2 * n + 1)
    assert 20 < len(gone) < 75
    base = samples.prose(4000, 300).split()
    for n in range(1000, 1150):
        copy = list(base)
        for _ in range(4):
            copy[r.randrange(300)] = f"new{r.randrange(10**6)}"
        texts.append((n, " ".join(copy)))
    group = {i: t for i, t in texts if i >= 1000}
    linked = smallest(sorted(group), lambda a, b: jaccard(group[a], group[b]) >= 0.8)
    gone |= {i for i in group if linked[i] != i}
    docs = samples.frame(spark, [(i, t, None, None, None, "x", 1, "k", None, 1, 2) for i, t in texts])
    kept = {x.doc_id for x in simhash.one_of_each(docs).collect()}
    assert kept == {i for i, _ in texts} - gone


def shared_items(spark):
    """Items that share a template or are copies, and documents with them, one of them twice."""
    template = samples.prose(3000, 20)
    items = [(n, f"{samples.prose(3001 + n, 15)} {template} {samples.prose(3010 + n, 15)}") for n in (1, 2)]
    items += [(3, items[0][1]), (4, template)]
    docs = [(1, f"{samples.prose(3020, 30)} {items[0][1]} {samples.prose(3021, 10)}"), (2, items[1][1])]
    docs = [(i, t, None, None, None, "x", 1, "k", None, 1, 2) for i, t in [*docs, docs[1]]]
    return samples.frame(spark, docs), spark.createDataFrame(items, "item_id long, text string")


def all_overlaps(docs, items):
    """Windows of 12 with at most two changes, all against all, merged on their diagonals."""
    out = []
    for d, text in docs:
        a = text.split()
        for item, text in items:
            b = text.split()
            for diagonal in range(-len(b), len(a)):
                hits = [x for x in range(max(0, diagonal), min(len(a), len(b) + diagonal) - 11)
                        if sum(a[x + k] != b[x + k - diagonal] for k in range(12)) <= 2]
                for n, x in enumerate(hits):
                    if n and x <= hits[n - 1] + 12:
                        out[-1] = (*out[-1][:3], x + 12, out[-1][4])
                    else:
                        out.append((d, item, x, x + 12, x - diagonal))
    return sorted(out)


def test_every_item_of_a_shared_window(spark):
    docs, bench = shared_items(spark)
    want = all_overlaps([(r.doc_id, r.text) for r in docs.collect()], [tuple(r) for r in bench.collect()])
    assert sorted(tuple(r) for r in decontaminate.overlaps(docs, bench).collect()) == want
    assert {i for d, i, *_ in want if d == 1} == {1, 2, 3, 4} and (1, 3, 30, 80, 0) in want


def test_blocks_give_the_same_rows(spark, monkeypatch):
    docs, bench = shared_items(spark)
    one = sorted(tuple(r) for r in decontaminate.overlaps(docs, bench).collect())
    leaks = samples.frame(spark, leaky())
    known = spark.createDataFrame(BENCH, "item_id long, text string")
    two = sorted(map(str, decontaminate.overlaps(leaks, known).collect()))
    monkeypatch.setattr(decontaminate, "BLOCK", 20)
    assert sorted(tuple(r) for r in decontaminate.overlaps(docs, bench).collect()) == one
    assert sorted(map(str, decontaminate.overlaps(leaks, known).collect())) == two


def test_all_texts_of_a_repeated_id_stay(spark):
    """Copies go, other texts of the same doc_id do not; columns with any name pass through."""
    rows = [(1, samples.prose(1, 60), "a", "b"), (1, samples.prose(2, 60), "c", "d"), (1, samples.prose(2, 60), "c", "d"),
            (2, samples.prose(2, 60) + " more", "e", "f"), (None, samples.prose(3, 60), None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _key string, _point string")
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(map(repr, (tuple(r) for r in kept.collect()))) == sorted(map(repr, [rows[0], rows[1], rows[4]]))


def boilerplate(n: int) -> list[tuple[int, str]]:
    common = samples.prose(600, 150)
    return [(i, f"{common} {samples.prose(7000 + i, 90, 10**6)}") for i in range(n)]


def test_common_boilerplate_gives_no_candidates(spark, monkeypatch):
    """Texts that share most of their words but stay below 0.8 share keys, but their sketches part them."""
    counts = []
    real = similar.stored

    def counted(df, name):
        out = real(df, name)
        if name in ("pairs", "partners"):
            counts.append(out.count())
        return out

    monkeypatch.setattr(similar, "stored", counted)
    for n in (300, 900):
        counts.clear()
        docs = [(i, t, None, None, None, "x", 1, "k", None, 1, 2) for i, t in boilerplate(n)]
        assert simhash.one_of_each(samples.frame(spark, docs)).count() == n
        assert sum(counts) <= n


@pytest.mark.parametrize("block", [3, 512])
def test_groups_in_blocks_of_any_size(spark, block):
    """Chains of copies that the hubs miss are found by pairs of blocks."""
    texts, r = [], random.Random(4)
    for family in range(6):
        words = samples.prose(8000 + family, 90).split()
        for n in range(14):  # each copy changes the one before
            texts.append((family * 100 + n, " ".join(words)))
            words[r.randrange(90)] = f"new{r.randrange(10**6)}"
    keyed = spark.createDataFrame(texts, "_key long, text string").withColumn("_point", F.xxhash64("text"))
    root = {x.first: x.root for x in similar.groups(keyed, block).collect()}
    by = dict(texts)
    linked = smallest(sorted(by), lambda a, b: a // 100 == b // 100 and jaccard(by[a], by[b]) >= 0.8)
    assert all((root[a] == root[b]) == (linked[a] == linked[b]) for a in by for b in by)


def test_pipeline_stage_takes_the_links_of_fingerprints(spark):
    """Texts whose fingerprints are near go, also where their different stretches are not similar."""
    often = " ".join("ab cd ef gh ij kl mn".split() * 60)
    rows = [(i, f"{often} {' '.join(f'w{i}x{k}' for k in range(14))}") for i in range(3)]
    rows += [(10, " ".join(f"other{k}" for k in range(80))), (11, " ".join(f"other{k}" for k in range(81)))]
    rows += [(20, " ".join(f"third{k}" for k in range(80)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.one_of_each(docs).collect()) == [0, 10, 20]
