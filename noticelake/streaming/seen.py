"""Keys seen so far, kept without a horizon: parts in hash buckets with a bitmap sketch per cell.

A part holds the keys that the batches ``first .. upto - 1`` added, one folder per bucket, and per cell
(a share of a bucket) a bitmap of ``BITS`` bits in which every key sets two. The numbers of buckets and
cells of a part follow its keys, so files and the fill of bitmaps are alike at any size. A batch tests its keys against the
bitmaps and reads only those buckets of those parts that may hold one of them; keys no bitmap
knows are new without any look at stored keys.

A part counts once its row in ``parts`` is there, which is written last; the row is one file. When the
newest parts together hold at least half as many keys as the one before them they are merged, so their
number grows with the logarithm of the keys. Merged ranges contain or avoid each other: a reader takes
the widest ones that end at or before its own batch, so a replayed batch sees what it saw before.
"""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from noticelake.session import scratch_path

BITS = 8 * 4096  # what bitmap_construct_agg fills
KEYS_PER_CELL = BITS // 8
PARTS = ("first", "upto", "buckets", "cells", "keys")
_PARTS = ", ".join(f"{name} long" for name in PARTS)


def _shares(keys: int, size: int) -> int:
    """The smallest power of two of shares that hold about ``size`` keys each."""
    return 1 << max(0, -(-keys // size) - 1).bit_length()


def _cell(key: str, part: dict) -> list[Column]:
    """Bucket and cell of a key. Both numbers are powers of two, so a cell lies in one bucket."""
    return [F.pmod(F.xxhash64(key), F.lit(part[kind])).alias(name)
            for name, kind in (("bucket", "buckets"), ("cell", "cells"))]


def _bits(key: str) -> list[Column]:
    return [F.pmod(F.xxhash64(F.lit(salt), F.col(key)), F.lit(BITS)) for salt in (1, 2)]


def _is_set(bitmap: Column, bit: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bitmap, (bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.call_function("getbit", byte, F.pmod(bit, F.lit(8)).cast("int")) == 1


class SeenKeys:
    """The keys of column ``key`` below ``path``, in buckets of about ``bucket_keys`` keys."""

    def __init__(self, spark: SparkSession, path: str, key: T.StructField, bucket_keys: int = 200_000):
        self.spark, self.path, self.key, self.bucket_keys = spark, path, key, max(bucket_keys, KEYS_PER_CELL)

    def parts(self, before: int | None = None) -> list[dict]:
        """The widest parts that end at or before batch ``before``, oldest first. One small row each."""
        try:
            rows = self.spark.read.schema(_PARTS).parquet(f"{self.path}/parts").select(*PARTS).collect()
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return []
        rows = sorted({tuple(r) for r in rows if before is None or r["upto"] <= before}, key=lambda r: (r[0], -r[1]))
        found: list[dict] = []
        for row in rows:
            part = dict(zip(PARTS, row, strict=True))
            if not found or part["first"] >= found[-1]["upto"]:
                found.append(part)
        return found

    def _folder(self, kind: str, part: dict) -> str:
        return f"{self.path}/{kind}/part={part['first']}-{part['upto']}"

    def _stored(self, parts: list[dict]) -> DataFrame:
        """The keys of the parts. Folders are named one by one, as superseded ones stay."""
        schema = T.StructType([self.key])
        tables = [self.spark.read.schema(schema).parquet(self._folder("keys", p)) for p in parts]
        return reduce(DataFrame.unionByName, [t.select(self.key.name) for t in tables])

    def add(self, keys: DataFrame, first: int, upto: int) -> None:
        """Write different, stored keys as the part of a range of batches; its row comes last."""
        n = keys.count()
        part = dict(zip(PARTS, (first, upto, _shares(n, self.bucket_keys), _shares(n, KEYS_PER_CELL), n), strict=True))
        name, folder = self.key.name, self._folder("keys", part)
        # One file per bucket: rows meet by bucket before they are written.
        keys.select(name, _cell(name, part)[0]).repartition("bucket").write.mode("overwrite").partitionBy(
            "bucket").parquet(folder)
        bits = keys.select(*_cell(name, part), F.explode(F.array(*_bits(name))).alias("bit"))
        bits.groupBy("bucket", "cell").agg(F.bitmap_construct_agg("bit").alias("bitmap")).write.mode(
            "overwrite").parquet(self._folder("sketches", part))
        row = self.spark.createDataFrame([tuple(part.values())], _PARTS)
        row.coalesce(1).write.mode("overwrite").parquet(self._folder("parts", part))

    def merge(self, before: int) -> None:
        """Merge the newest parts while they hold half as many keys as the part before them."""
        parts, total = self.parts(before), 0
        at = len(parts)
        while at and (at == len(parts) or 2 * total >= parts[at - 1]["keys"]):
            at -= 1
            total += parts[at]["keys"]
        newest = parts[at:]
        if len(newest) > 1:
            self.add(self._stored(newest), newest[0]["first"], newest[-1]["upto"])

    def suspects(self, keys: DataFrame, before: int | None = None) -> DataFrame:
        """``key, part, bucket`` for every part whose bitmap may hold the key."""
        name, parts = self.key.name, self.parts(before)
        places = T.StructType([self.key, T.StructField("part", T.IntegerType()), T.StructField("bucket", T.LongType())])
        if not parts:
            return keys.sparkSession.createDataFrame([], places)
        shape = "bucket long, cell long, bitmap binary"
        sketches = reduce(DataFrame.unionByName, [
            self.spark.read.schema(shape).parquet(self._folder("sketches", p)).withColumn("part", F.lit(i))
            for i, p in enumerate(parts)])
        cells = F.array(*[F.struct(F.lit(i).alias("part"), *_cell(name, p))
                          for i, p in enumerate(parts)])
        asked = keys.select(name, F.inline(cells))
        held = asked.join(sketches, ["part", "bucket", "cell"])
        for bit in _bits(name):
            held = held.filter(_is_set(F.col("bitmap"), bit))
        return held.select(name, "part", "bucket")

    def known(self, keys: DataFrame, before: int | None = None) -> DataFrame:
        """Those of the keys that are stored. Only buckets with a suspect are read."""
        name, parts = self.key.name, self.parts(before)
        path = scratch_path(self.spark, "suspects")
        found = self.suspects(keys, before)
        found.write.parquet(path)
        found = self.spark.read.schema(found.schema).parquet(path)
        out = self.spark.createDataFrame([], T.StructType([self.key]))
        # At most one row per part and bucket.
        for row in found.groupBy("part").agg(F.sort_array(F.collect_set("bucket")).alias("buckets")).collect():
            folder = self._folder("keys", parts[row["part"]])
            stored = self.spark.read.schema(T.StructType([self.key])).parquet(
                *(f"{folder}/bucket={bucket}" for bucket in row["buckets"]))
            out = out.unionByName(stored)
        return found.select(name).distinct().join(out, name, "left_semi")
