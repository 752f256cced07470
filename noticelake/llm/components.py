"""Connected components of a graph given as links, by alternating stars.

Each round hangs every larger neighbour on the smallest one (large star), then every node on its
smallest (small star), as aggregates and joins on the links alone. Rounds are written to the
shared folder; only a count and a checksum reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticelake.llm.repeats import stored


def _signature(e: DataFrame):
    return e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()


def components(links: DataFrame) -> DataFrame:
    """``links`` (u, v) of longs -> ``node``, ``root``: the smallest node of its component.

    Only nodes with a link to another node appear.
    """
    e = links.filter("u != v").select(F.greatest("u", "v").alias("a"), F.least("u", "v").alias("b"))
    e = stored(e.distinct(), "links")
    before = _signature(e)
    while True:
        ends = e.select(F.col("a").alias("x"), F.col("b").alias("y")).unionByName(
            e.select(F.col("b").alias("x"), F.col("a").alias("y")))
        least = ends.groupBy("x").agg(F.least(F.min("y"), F.first("x")).alias("m"))
        large = e.join(least, e["b"] == least["x"]).select("a", F.col("m").alias("b")).distinct()
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        down = large.join(small, "a").filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = stored(down.unionByName(small.select("a", F.col("m").alias("b"))).distinct(), "links")
        now = _signature(e)
        if now == before:
            return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = now
