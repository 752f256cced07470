"""The manifest against a tree that is built in one list."""

from __future__ import annotations

import zlib
from hashlib import sha256

import pytest
from oracle import connect, differences
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from noticelake.llm import manifest, queries

SCHEMA = StructType([
    StructField("doc_id", LongType()), StructField("source", StringType()), StructField("lang", StringType()),
    StructField("n_chars", LongType()), StructField("text", StringType()), StructField("l", IntegerType()),
    StructField("r", StringType()), StructField("total", StringType())])


def h(*parts: str) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def leaf(row, more=0) -> str:
    values = [row[0], row[1], row[2], None if row[3] is None else row[3] + more, row[4]]
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(nodes: list[str]):
    """All levels of a list of nodes."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i: i + 2]) for i in range(0, len(levels[-1]), 2)])
    return levels


def path(levels, i: int):
    for level in levels[:-1]:
        yield i, level[i ^ 1] if i ^ 1 < len(level) else None
        i >>= 1


def brute(rows) -> list[tuple]:
    groups: dict = {}
    for row in rows:
        groups.setdefault(row[2], []).append(row)
    langs = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    for x in langs:
        groups[x].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    trees = {x: tree([leaf(r) for r in groups[x]]) for x in langs}
    top = tree([trees[x][-1][0] for x in langs])
    out = []
    for g, x in enumerate(langs):
        for i, row in enumerate(groups[x]):
            steps = [*path(trees[x], i), *path(top, g)]
            bad = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 7 == 0
            node = leaf(row, 1 if bad else 0)
            for at, s in steps:
                node = h(node) if s is None else h(node, s) if at % 2 == 0 else h(s, node)
            out.append((row[0], leaf(row), trees[x][-1][0], top[-1][0], h(*(s for _, s in steps if s)), node,
                        node == top[-1][0], x, i))
    return sorted(out, key=repr)


def result(spark, rows, **more):
    df = spark.createDataFrame([(*r, 1, "r", "t") for r in rows], SCHEMA)
    return manifest.proved(df, altered=manifest.tampered(), **more)


@pytest.mark.parametrize("levels", [1, 2, 3, 10])
def test_equals_brute_force(spark, levels):
    rows = [(i * 37 % 1000 - 300, f"s{i % 3}" if i % 5 else None, ["en", "de", None, "", "é", "zz"][i % 6 if i % 4 else 0],
             i if i % 11 else None, ["", None, "x" * i, "ñ한😀"][i % 4]) for i in range(97)]
    rows += [(5_000_000_000_000, None, "one", 1, "t"), (-(1 << 63), None, "en", 1, "t"), ((1 << 63) - 1, None, "en", (1 << 63) - 1, "t")]
    got = result(spark, rows, at_once=levels)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified", "lang", "place"]
    got = sorted((tuple(r) for r in got.collect()), key=repr)
    assert got == brute(rows)
    assert {r[6] for r in got} == {True, False}


def test_repeated_and_missing_ids(spark):
    rows = [(7, None, "en", 1, f"t{i}") for i in range(9)] + [(7, None, "en", 1, "t1")] * 3
    rows += [(None, None, "en", 2, f"t{i}") for i in range(4)] + [(8, None, "en", 2, "x"), (6, None, "en", 2, "x")]
    rows += [(None, None, None, None, None)] * 2
    assert sorted((tuple(r) for r in result(spark, rows).collect()), key=repr) == brute(rows)


def test_one_row_and_no_row(spark):
    rows = [(3, "s", "en", 4, "text")]
    assert [tuple(r) for r in result(spark, rows).collect()] == brute(rows)
    assert result(spark, []).collect() == []


def test_proofs_fold_to_the_root(spark):
    rows = [(i, None, "en" if i % 3 else "de", i, f"t{i}") for i in range(50)]
    df = spark.createDataFrame([(*r, 1, "r", "t") for r in rows], SCHEMA)
    got = manifest.proved(df, siblings=True).collect()
    assert all(r["verified"] and manifest.fold(r["leaf"], r["turns"], r["proof"]) == r["root"] for r in got)
    assert not any(manifest.fold(h("other"), r["turns"], r["proof"]) == r["root"] for r in got)


def test_leaves_are_not_sorted(spark, sf_dir):
    """Text goes into digests in the scan's stage and into no exchange."""
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    plan = manifest._leaves(df, manifest.COLUMNS, manifest.tampered())._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan


def test_equals_sql(spark, sf_dir):
    frame = queries.QUERIES["op11_merkle_manifest"](spark, sf_dir)
    assert differences(frame.collect(), frame.columns, connect(sf_dir), manifest.SQL) == []
