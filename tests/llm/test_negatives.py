"""Hard negatives against all scores, for blocks of any size, and the pruning of far blocks."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from oracle import connect, differences
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from noticelake.llm import negatives, queries

SCHEMA = StructType([
    StructField("vec_id", LongType()), StructField("embedding", ArrayType(DoubleType())), StructField("label", IntegerType()),
    StructField("block", StringType()), StructField("id", StringType()), StructField("v", IntegerType())])


def brute(rows, every: int):
    kept: dict = {}
    for i, v, label in sorted((r for r in rows if None not in r), key=lambda r: (r[0], r[2])):
        if not any(x is None or not math.isfinite(x) for x in v):
            kept.setdefault(i, (label, [math.floor(256 * x) for x in v]))
    out = []
    for a, (label, v) in kept.items():
        if a % every:
            continue
        scores = sorted((-sum(x * y for x, y in zip(v, w)), i, m) for i, (m, w) in kept.items() if i != a)
        for s, p, _ in [x for x in scores if x[2] == label][:5]:
            fits = [x for x in scores if x[2] != label and 80 * -s <= 100 * -x[0] <= 100 * -s][:5]
            out += [(a, p, n + 1, i, -s, -t) for n, (t, i, _) in enumerate(fits)]
    return sorted(out)


def result(spark, rows, every=5, **sizes):
    df = spark.createDataFrame([(*r, "b", "i", 1) for r in rows], SCHEMA)
    got = negatives.mined(df, F.col("id") % every == 0, **sizes)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r) for r in got.collect())


def vectors(n: int, d: int, seed: int, groups: int = 0):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(max(groups, 1), d))
    x = centres[r.integers(0, max(groups, 1), n)] + (0.15 if groups else 1) * r.normal(size=(n, d))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return [(int(i), v.tolist(), int(r.integers(0, 3))) for i, v in enumerate(x)]


@pytest.mark.parametrize(("block", "slice"), [(1, 1), (7, 3), (2048, 512)])
def test_equals_all_scores(spark, block, slice):
    rows = vectors(150, 6, 1, groups=5)
    assert result(spark, rows, block=block, slice=slice) == brute(rows, 5) != []


def test_ties_nulls_and_odd_rows(spark):
    r = random.Random(3)
    some = [[0.5, 0.5, -0.25], [0.5, 0.5], [1.0, 0.0, 0.0], [0.0] * 3, [-1.0, 2.0, 0.1], []]
    rows = [(i, r.choice(some), r.randrange(3)) for i in range(120)]
    rows += [(200, None, 1), (205, [None, 1.0], 1), (210, [math.nan, 1.0], 1), (215, [math.inf], 1), (220, [1.0], None),
             (None, [1.0, 1.0], 1), (225, [3e3, -2e3, 5e3], 2), (230, [2.9e3, 0.0, 4e3], 0), (235, [1.0], 9)]
    rows += [rows[10]] * 3 + [(15, [0.1, 0.2, 0.3], 2)]
    unique = [x for x in rows if x[0] != 15]
    got = result(spark, unique, block=8, slice=4)
    assert got == brute(unique, 5)
    assert not {x[0] for x in got} & {200, 205, 210, 215, 220}
    assert result(spark, rows, block=8, slice=4) == result(spark, rows[::-1], block=8, slice=4)


def test_one_common_vector(spark):
    rows = [(i, [0.25, 0.5, 0.75], i % 2) for i in range(300)] + vectors(60, 3, 8)[5:]
    rows = [(i, v, m) for i, (_, v, m) in enumerate(rows)]
    assert result(spark, rows, 50, block=16, slice=4) == brute(rows, 50)


def test_no_rows(spark):
    assert result(spark, []) == [] == result(spark, [(1, [1.0], 1)]) == result(spark, [(5, [1.0], 1)])


def test_far_blocks_are_not_read(spark):
    rows = vectors(3000, 4, 4, groups=12)
    df = spark.createDataFrame([(i, m, np.floor(256 * np.array(v)).astype("<i4").tobytes()) for i, v, m in rows],
                               "id long, label long, v binary")
    held = negatives.Blocks(df, F.col("id") % 100 == 0, block=32, slice=8)
    window = F.array(negatives._window(F.lit(52_000), F.lit(1 << 40)))
    near, more = (held.chosen(held.anchors.select("id", window.alias("windows")), False, a) for a in (False, True))
    read = sum(len(r["anchors"]) for df in (near, more) for r in df.select("anchors").collect())
    assert 30 <= read < 0.35 * 30 * held.n


def test_hilbert_curve():
    for n, bits in ((2, 4), (3, 3), (4, 2)):
        points = np.stack(np.meshgrid(*[np.arange(1 << bits)] * n, indexing="ij"), -1).reshape(-1, n)
        place = negatives.hilbert(points, bits)
        assert sorted(place.tolist()) == list(range(len(points)))
        along = points[np.argsort(place)]
        assert (np.abs(np.diff(along, axis=0)).sum(axis=1) == 1).all()


def test_products_are_exact():
    r = np.random.default_rng(0)
    for size in (200, 100_000, negatives.LIMIT):
        a, b = r.integers(-size, size, (5, 40)), r.integers(-size, size, (7, 40))
        assert negatives.products(a, b).tolist() == [[sum(int(x) * int(y) for x, y in zip(u, v)) for v in b] for u in a]


def test_equals_sql(spark, sf_dir):
    frame = queries.QUERIES["op13_hard_negatives"](spark, sf_dir)
    assert differences(frame.collect(), frame.columns, connect(sf_dir), negatives.SQL) == []
