"""Small documents with everything that real tables hold, and brute-force helpers."""

from __future__ import annotations

import random
import re

from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Extra columns with names that operators use inside.
SCHEMA = StructType([
    StructField("doc_id", LongType()), StructField("text", StringType()), StructField("lang", StringType()),
    StructField("source", StringType()), StructField("n_chars", LongType()),
    StructField("spans", StringType()), StructField("score", IntegerType()), StructField("k", StringType()),
    StructField("component", StringType()), StructField("count", LongType()), StructField("fp", LongType()),
])


def prose(seed: int, words: int, vocabulary: int = 3000) -> str:
    r = random.Random(seed)
    common = "the of and to in a is that it was".split()
    return " ".join(
        r.choice(common) if r.random() < 0.3 else f"{chr(97 + x % 26)}{chr(97 + x // 26 % 26)}w{x}"
        for x in (r.randrange(vocabulary) for _ in range(words)))


def rows() -> list[tuple]:
    passage, one = prose(1, 80), prose(2, 150)
    texts = [
        (0, prose(10, 200)), (1, passage), (2, f"{prose(11, 60)}\n{passage}\n{prose(12, 60)}"),
        (3, one), (4, one), (5, one.replace("the", "thee", 1)), (6, None), (7, ""), (8, " \t\n"),
        (9, "Der der der " * 40), (10, "x"), (11, "x"), (12, prose(13, 6000)), (13, f"{passage} {passage}"),
        (14, prose(14, 300) + "\x00\x1c\x85 ñandú ﬁ 한국 😀 " + passage.upper()), (None, one), (None, prose(15, 90)),
        (15, prose(16, 40)), (15, prose(16, 40)), (16, "a b c d " * 60), (17, prose(17, 19)), (18, prose(17, 20)),
        (19, passage[:-1]), (20, f"{prose(18, 30)} {' '.join(passage.split()[10:70])} {prose(19, 30)}"),
    ]
    return [(i, t, "en", None, None, "x", 7, "k", None, 1, 2) for i, t in texts]


def frame(spark, data=None):
    return spark.createDataFrame(rows() if data is None else data, SCHEMA)


def key(row: tuple) -> tuple:
    """The order of documents: rows without an id first, by their text."""
    return (row[0] is not None, row[0] if row[0] is not None else row[1] or "")


def covered(data: list[tuple], length: int) -> dict[tuple, list[bool]]:
    """Per (doc_id, text): which words lie in a window that also starts earlier.

    Rows without an id take their place before the others; their order among themselves is free,
    so the samples hold no two of them with a common window.
    """
    first: dict[tuple, tuple] = {}
    documents = sorted({(r[0], r[1] or "") for r in data}, key=key)
    windows = {}
    for n, (i, t) in enumerate(documents):
        words = WORD.findall(t)
        windows[i, t] = [tuple(words[p: p + length]) for p in range(len(words) - length + 1)]
        for p, w in enumerate(windows[i, t]):
            first.setdefault(w, (n, p))
    out = {}
    for n, (i, t) in enumerate(documents):
        mark = [False] * len(WORD.findall(t))
        for p, w in enumerate(windows[i, t]):
            if first[w] != (n, p):
                mark[p: p + length] = [True] * length
        out[i, t] = mark
    return out
