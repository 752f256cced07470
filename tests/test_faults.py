"""Ordinary input that once gave wrong rows or killed a task."""

from fixtures import notices, numbered, rows
from pyspark.sql import functions as F

from noticelake.config import CommitOptions
from noticelake.functions.text import tokenize
from noticelake.operators import feed as fd
from noticelake.operators import index as ix
from noticelake.plans.commit import commit_snapshot
from noticelake.sources.lake import NoticeLake
from noticelake.streaming.incremental import exact_feed, exact_new_notices, incremental_commit


def commit(spark, root, run, n, **more):
    return commit_snapshot(spark, n, root, run, more.pop("as_of", "2026-02-10"), **more)


def test_long_words_of_joined_numbers_and_letters(spark):
    texts = spark.createDataFrame([("1," * 100_000,), ("a.b'" * 50_000,), ("7.5 x,y",)], "t string")
    words = [r["w"] for r in texts.select(tokenize(F.col("t"), 1).alias("w")).collect()]
    assert [len(w) for w in words] == [1, 1, 3] and len(words[0][0]) == 199_999


def test_search_tells_colliding_ids_apart(spark):
    n = notices(spark, dict(id="abc123", notice_key="k1", title="apple"), dict(id="abc123", notice_key="k2", title="pear"))
    postings = ix.build_postings(n)
    assert ix.search_notices(postings, n, "apple pear").count() == 0
    assert rows(ix.search_notices(postings, n, "pear"), "notice_key") == [("k2",)]


def test_repeated_keys_are_committed_once(spark, tmp_path):
    n = numbered(spark, 20)
    row = commit(spark, str(tmp_path), "r1", n.unionByName(n))
    assert row["current_count"] == 20


def test_a_rejected_run_can_be_forced(spark, tmp_path):
    root = str(tmp_path)
    commit(spark, root, "r1", numbered(spark, 100))
    assert not commit(spark, root, "r2", numbered(spark, 10))["committed"]
    row = commit(spark, root, "r2", numbered(spark, 10), options=CommitOptions(force=True))
    assert row["committed"] and commit(spark, root, "r2", numbered(spark, 5))["current_count"] == 10


def test_every_committed_key_is_hot_or_archived(spark, tmp_path):
    root, lake = str(tmp_path), NoticeLake(spark, str(tmp_path))
    first = numbered(spark, 30).withColumn(
        "date", F.when(F.col("notice_key").isin([r[0] for r in rows(numbered(spark, 30), "notice_key")][:2]),
                       "soon").otherwise(F.col("date")))
    keys = {r[0] for r in rows(first, "notice_key")}
    order = sorted(keys)
    commit(spark, root, "r1", first)
    commit(spark, root, "r2", first.filter(~F.col("notice_key").isin(order[-2:])))
    later = numbered(spark, 30, "2026-03-02").withColumn("notice_key", F.concat(F.lit("m"), "notice_key"))
    commit(spark, root, "r3", later, as_of="2026-03-05")
    have = {r[0] for r in rows(lake.archive(), "notice_key")} | {r[0] for r in rows(lake.read_current(), "notice_key")}
    assert keys <= have


def test_backfill_keeps_rows_without_link_or_date(spark):
    hot = notices(spark, dict(title="1", link=None, date="2026-02-01"), dict(title="2", link="l", date=None),
                  dict(title="3", link="m", date="1999"))
    months = notices(spark, dict(title="4", link=None, date="2026-01-01")).withColumn("year", F.lit(2026)).withColumn(
        "month", F.lit(1))
    assert fd.backfill_months(hot, months) == [(2026, 1)]
    got = {(r["title"], r["page"]) for r in fd.month_backfill(hot, months).collect()}
    assert got == {("1", 0), ("2", 0), ("3", 0), ("4", 1)}


def test_nested_form_has_normal_dates(spark):
    n = notices(spark, dict(notice_key="1", date="2026.02.03"))
    assert fd.to_nested(n).first()["metadata"]["date"] == "2026-02-03"


def test_two_runs_of_one_trigger_stay_two(spark, tmp_path):
    for run, count in (("r1", 100), ("r2", 95)):
        numbered(spark, count).withColumn("run_id", F.lit(run)).write.mode("append").parquet(f"{tmp_path}/in")
    schema = spark.read.parquet(f"{tmp_path}/in").schema
    stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
    incremental_commit(stream, f"{tmp_path}/lake", f"{tmp_path}/state", "2026-02-10").awaitTermination()
    found = NoticeLake(spark, f"{tmp_path}/lake").manifest().orderBy("seq").collect()
    assert [(r["run_id"], r["current_count"], r["removed"]) for r in found] == [("r1", 100, 0), ("r2", 95, 5)]


def test_exact_feed(spark, tmp_path):
    out, seen = f"{tmp_path}/out", f"{tmp_path}/seen"
    write = exact_feed(out, seen)
    one, two = numbered(spark, 3), numbered(spark, 5)
    assert exact_new_notices(spark, one, seen).count() == 3
    write(one.unionByName(one), 0)
    write(two, 1)
    write(two, 1)  # replayed
    got = spark.read.parquet(out).groupBy("batch").count().collect()
    assert {(r["batch"], r["count"]) for r in got} == {(0, 3), (1, 2)}
