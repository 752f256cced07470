"""Seen keys: exact against a set, sketches that spare buckets, merged parts, replays."""

import random

from pyspark.sql import functions as F

from noticelake.streaming.incremental import exact_feed, exact_new_notices
from noticelake.streaming.seen import SeenKeys


def keyed(spark, keys):
    return spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "notice_key string, n long")


def test_batches_equal_a_set(spark, tmp_path):
    out, seen = f"{tmp_path}/out", f"{tmp_path}/seen"
    write, known, rng = exact_feed(out, seen), set(), random.Random(5)
    for batch in range(7):
        keys = [f"k{rng.randrange(150)}" for _ in range(40)] + ["", None]
        write(keyed(spark, keys), batch)
        if batch in (2, 5):  # replayed
            write(keyed(spark, keys), batch)
        got = [r["notice_key"] for r in spark.read.parquet(f"{out}/batch={batch}").collect()]
        fresh = set(keys) - known
        assert len(got) == len(fresh) and set(got) == fresh
        known |= {k for k in keys if k is not None}


def test_only_suspect_buckets_are_read(spark, tmp_path):
    field = keyed(spark, ["a"]).schema["notice_key"]
    seen = SeenKeys(spark, str(tmp_path), field, bucket_keys=1)
    stored = spark.range(20_000).select(F.concat(F.lit("k"), "id").alias("notice_key"))
    seen.add(stored, 0, 1)
    asked = keyed(spark, [f"k{i}" for i in range(3)] + [f"x{i}" for i in range(2_000)]).select("notice_key")
    found = seen.suspects(asked)
    assert found.filter("notice_key LIKE 'k%'").count() == 3
    assert found.filter("notice_key LIKE 'x%'").count() < 150  # 4 % at this fill
    assert seen.parts()[0]["buckets"] == 8
    assert sorted(r[0] for r in seen.known(asked).collect()) == ["k0", "k1", "k2"]
    few = seen.known(keyed(spark, ["k0"]).select("notice_key"))
    assert sum("bucket=" in f for f in few.inputFiles()) == 1


def test_parts_are_merged_and_earlier_batches_see_earlier_parts(spark, tmp_path):
    field = keyed(spark, ["a"]).schema["notice_key"]
    seen = SeenKeys(spark, str(tmp_path), field)
    for batch in range(9):
        seen.merge(batch)
        seen.add(keyed(spark, [f"k{batch}-{i}" for i in range(20)]).select("notice_key"), batch, batch + 1)
    parts = seen.parts()
    assert len(parts) < 6 and sum(p["keys"] for p in parts) == 180
    assert [p["first"] for p in parts][1:] == [p["upto"] for p in parts][:-1]
    asked = keyed(spark, ["k0-1", "k3-1", "k8-1", "z"])
    assert {r[0] for r in seen.known(asked.select("notice_key"), before=3).collect()} == {"k0-1"}
    assert {r[0] for r in exact_new_notices(spark, asked, str(tmp_path)).select("notice_key").collect()} == {"z"}


def test_sketches_grow_with_the_keys(spark, tmp_path):
    field = spark.range(1).schema["id"]
    seen = SeenKeys(spark, str(tmp_path), field)
    seen.add(spark.range(60_000), 0, 1)
    assert seen.parts()[0]["cells"] == 16
    fill = spark.read.parquet(f"{tmp_path}/sketches").agg(F.max(F.bitmap_count("bitmap"))).first()[0]
    assert fill < 0.3 * 8 * 4096
    assert seen.known(spark.range(59_990, 60_010)).count() == 10
