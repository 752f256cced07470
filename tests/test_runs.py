import os
from datetime import datetime, timezone

import pytest
from fixtures import keyed, notices, numbered, rows
from pyspark.sql import functions as F

from noticelake.config import CommitOptions, Config, SeedCampus, IndexRules
from noticelake.operators import feed as fd
from noticelake.operators import index as ix
from noticelake.operators import snapshot as sn
from noticelake.operators.dedupe import dedupe_first, id_collisions, join_dimension
from noticelake.operators.feed import in_months
from noticelake.plans.commit import commit_snapshot, merge_archive
from noticelake.plans.feed import feed
from noticelake.sources.lake import ARCHIVE, NoticeLake
from noticelake.streaming.incremental import commit_batches, incremental_commit, new_notice_feed


def changes(spark, before, now, **options):
    return rows(sn.change_feed(keyed(spark, *before) if before else numbered(spark, 0),
                               keyed(spark, *now) if now else numbered(spark, 0), **options), "change", "notice_key")


def test_change_feed(spark):
    a, b, c = ("001", "A"), ("002", "B"), ("003", "C")
    assert changes(spark, [a, b], [a, b]) == []
    assert changes(spark, [a], [a, b]) == [("added", "002")]
    assert changes(spark, [a, b], [a]) == [("removed", "002")]
    assert changes(spark, [a], [("001", "A2")]) == [("updated", "001")]
    mixed = changes(spark, [a, b, c], [a, ("002", "B2"), ("004", "D")])
    assert mixed == [("added", "004"), ("removed", "003"), ("updated", "002")]
    assert changes(spark, [a, b], [a, ("002", "B2")], detect_updates=False) == []
    assert changes(spark, [], [a, b]) == [("added", "001"), ("added", "002")]
    assert changes(spark, [a, b], []) == [("removed", "001"), ("removed", "002")]


def test_change_feed_rows_and_counts(spark):
    feed_ = sn.change_feed(keyed(spark, ("1", "A"), ("2", "B")), keyed(spark, ("2", "B2"), ("3", "C")))
    assert {(r["change"], r["title"]) for r in feed_.collect()} == {("removed", None), ("updated", "B2"), ("added", "C")}
    total = sn.change_counts(feed_).first()
    assert (total["change_count"], total["has_changes"]) == (3, True)


def test_dedupe_against_brute_force(spark):
    # One key holds a third of the rows.
    data = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") * 7919 % 500).cast("string"))).alias("notice_key"),
        (F.col("id") * 31 % 97).alias("board_ord"), F.col("id").alias("row_pos"))
    want = {}
    for r in data.collect():
        entry = (r["board_ord"], r["row_pos"])
        want[r["notice_key"]] = min(want.get(r["notice_key"], entry), entry)
    got = {r["notice_key"]: (r["board_ord"], r["row_pos"]) for r in dedupe_first(data).collect()}
    assert got == want


def test_dedupe_limits_rows_before_the_shuffle(spark):
    plan = dedupe_first(spark.range(10).selectExpr("id % 4 notice_key", "id board_ord", "id row_pos"))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in text and text.index("Exchange") < text.rindex("WindowGroupLimit")


def test_id_collisions(spark):
    n = notices(spark, dict(id="a", notice_key="a1"), dict(id="a", notice_key="a2"), dict(id="b", notice_key="b1"))
    assert rows(id_collisions(n), "id", "notices") == [("a", 2)]


@pytest.mark.parametrize("bound", [1, 100])
def test_join_dimension_either_way(spark, bound):
    fact = spark.range(10).selectExpr("id % 4 k", "id")
    dim = spark.createDataFrame([(0, "x"), (1, "y"), (2, "z")], "k long, n string")
    joined = join_dimension(fact, dim, "k", "inner", max_rows=bound)
    assert joined.count() == 8
    text = joined._jdf.queryExecution().optimizedPlan().toString()
    assert ("broadcast" in text.lower()) == (bound == 100)


# Commit


def commit(spark, root, run_id, frame, as_of="2026-02-10", **kw):
    return commit_snapshot(spark, frame, root, run_id, as_of, **kw)


def test_commit_cycle(spark, tmp_path):
    root = str(tmp_path / "lake")
    lake = NoticeLake(spark, root)
    assert lake.read_current().count() == 0 and lake.latest() is None and lake.read_index() is None
    hot, cold = numbered(spark, 40), numbered(spark, 60, "2026-01-05")
    first = commit(spark, root, "r1", hot.unionByName(cold))
    assert (first["status"], first["hot_count"], first["cold_months"], first["added"]) == ("cold_start", 40, 1, 100)
    assert lake.read_current().count() == 40 and lake.read_archive(2026, 1).count() == 60
    assert lake.read_archive(2025, 1).count() == 0

    # A drop of more than a fifth stops the run and leaves what readers see untouched.
    bad = commit(spark, root, "r2", hot)
    assert (bad["status"], bad["committed"], bad["hot_count"], bad["drop_percent"]) == ("triggered", False, 0, 60.0)
    empty = commit(spark, root, "r3", hot.limit(0))
    assert (empty["status"], empty["committed"]) == ("empty_result", False)
    assert lake.latest()["run_id"] == "r1" and lake.read_current().count() == 40

    # The next good run is compared with the last committed one.
    retitled = cold.withColumn("title", F.lit("new title"))
    good = commit(spark, root, "r4", hot.unionByName(retitled).unionByName(numbered(spark, 5, "2026-03-01")))
    assert (good["status"], good["added"], good["updated"], good["removed"]) == ("safe", 5, 60, 0)
    assert good["previous_count"] == 100 and good["seq"] == 3
    # First write wins in the archive; the future month is cold too.
    assert rows(lake.read_archive(2026, 1).select("title").distinct(), "title") == [("t",)]
    assert lake.read_archive(2026, 3).count() == 5
    assert lake.read_changes().count() == 65
    assert lake.read_index().filter("token = 'title'").count() == 60

    # The same run again does nothing.
    files = sorted(p for p, *_ in os.walk(root))
    again = commit(spark, root, "r4", hot)
    assert again == lake.run("r4") and sorted(p for p, *_ in os.walk(root)) == files


def test_commit_options(spark, tmp_path):
    root = str(tmp_path / "lake")
    commit(spark, root, "r1", numbered(spark, 100))
    forced = commit(spark, root, "r2", numbered(spark, 10), options=CommitOptions(force=True))
    assert (forced["status"], forced["committed"]) == ("triggered", True)
    off = commit(spark, root, "r3", numbered(spark, 1),
                 options=CommitOptions(circuit_breaker=False, generate_index=False, calculate_diff=False))
    assert off["committed"] and off["added"] is None and off["index_version"] is None
    assert NoticeLake(spark, root).read_index() is None


def test_hot_baseline(spark, tmp_path):
    root = str(tmp_path / "lake")
    commit(spark, root, "r1", numbered(spark, 20).unionByName(numbered(spark, 80, "2026-01-05")))
    row = commit(spark, root, "r2", numbered(spark, 20), options=CommitOptions(baseline="hot"))
    assert (row["status"], row["previous_count"], row["added"]) == ("safe", 20, 0)


def test_damaged_snapshot_is_no_first_run(spark, tmp_path):
    root = str(tmp_path / "lake")
    commit(spark, root, "r1", numbered(spark, 20))
    for name in os.listdir(f"{root}/manifest/run=r1"):
        if name.endswith(".parquet"):
            with open(f"{root}/manifest/run=r1/{name}", "wb") as f:
                f.write(b"broken")
            os.unlink(f"{root}/manifest/run=r1/.{name}.crc")
    with pytest.raises(Exception):
        commit(spark, root, "r2", numbered(spark, 1))


def test_rollover_keeps_vanished_rows(spark, tmp_path):
    root = str(tmp_path / "lake")
    commit(spark, root, "r1", numbered(spark, 30))
    still = numbered(spark, 25).unionByName(numbered(spark, 3, "2026-03-02"))
    row = commit(spark, root, "r2", still, as_of="2026-03-05")
    assert row["hot_count"] == 3
    assert NoticeLake(spark, root).read_archive(2026, 2).count() == 30


def test_archive_merge_is_idempotent_and_pruned(spark, tmp_path):
    lake = NoticeLake(spark, str(tmp_path / "lake"))
    frame = numbered(spark, 30).unionByName(numbered(spark, 30, "2025-12-01")).unionByName(numbered(spark, 3, "2025-11-01"))
    cold = sn.month_partition(frame, "2027-01-01").select(*ARCHIVE.names)
    months, folders = merge_archive(cold, lake, "a", [])
    assert months == 3 and merge_archive(cold, lake, "b", folders) == (3, folders)
    assert merge_archive(cold, lake, "a", []) == (3, folders)
    assert lake.archive(folders).count() == 63 and lake.archive().count() == 0
    some = in_months(lake.archive(folders), [(2025, 12), (2026, 2), (1999, 1)])
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert some.count() == 60 and "PartitionFilters: [" in plan and "year" in plan.split("PartitionFilters: [")[1][:80]


def state(lake):
    return {t: rows(df, "notice_key", "title") for t, df in (
        ("archive", lake.archive()), ("current", lake.read_current()), ("snapshot", lake.read_snapshot()))}


def test_a_run_that_dies_before_its_row_leaves_no_trace(spark, tmp_path, monkeypatch):
    """Readers see the old state, another run starts from it, and a repetition gives the usual result."""
    root, lake = str(tmp_path / "lake"), NoticeLake(spark, str(tmp_path / "lake"))
    first = numbered(spark, 30).unionByName(numbered(spark, 20, "2026-01-05"))
    late = first.unionByName(numbered(spark, 7, "2025-12-24")).withColumn("title", F.lit("late"))
    commit(spark, root, "r1", first)
    before = state(lake)
    with monkeypatch.context() as m:
        m.setattr(NoticeLake, "publish", lambda self, row: (_ for _ in ()).throw(RuntimeError("died")))
        with pytest.raises(RuntimeError):
            commit(spark, root, "r2", late)
    assert state(lake) == before and any("part=r2" in p for p, *_ in os.walk(root))
    commit(spark, root, "r3", first.unionByName(numbered(spark, 7, "2025-12-24")))
    assert {t for _, t in state(lake)["archive"]} == {"t"} and lake.read_archive(2025, 12).count() == 7
    again = commit(spark, root, "r2", late)
    assert again["committed"] and lake.archive().count() == 27
    assert {t for _, t in state(lake)["archive"]} == {"t"}


def test_months_are_rewritten_when_they_have_many_folders(spark, tmp_path):
    lake, folders, seen = NoticeLake(spark, str(tmp_path)), [], 0
    for n in range(7):
        more = numbered(spark, 10 * n + 10, "2026-01-05").unionByName(numbered(spark, 3, "2025-11-05"))
        cold = sn.month_partition(more, "2027-01-01").select(*ARCHIVE.names)
        old = folders
        _, folders = merge_archive(cold, lake, f"p{n}", folders, most=3)
        january = [f for f in folders if f.endswith("year=2026/month=1")]
        assert 1 <= len(january) <= 3 and lake.archive(folders).count() == 10 * n + 13
        assert lake.archive(old).count() == seen  # who still reads the list before sees what it held
        seen = 10 * n + 13
    assert [f for f in folders if f.endswith("month=11")] == ["part=p0/year=2025/month=11"]


def test_diff_invariants(spark, sf_dir):
    from noticelake.catalog import views as v

    n = v.notices(spark, sf_dir)
    before, now = v.earlier_run(n), v.later_run(n)
    c = sn.change_counts(sn.change_feed(before, now)).first()
    common = sn.unchanged_ids(before, now).count()
    assert now.count() == c["added"] + common and before.count() == c["removed"] + common


# Index


def test_index_goldens(spark):
    base = dict(campus="신촌캠퍼스", college="공과대학", department_name="컴퓨터공학과", board_name="학사공지")
    n = notices(spark, *[dict(id=i, notice_key=i, title=t, **base) for i, t in [
        ("001", "장학금 신청 안내"), ("002", "기숙사 입사 신청"), ("003", "장학금 수령 방법"), ("004", "the quick brown fox"),
        ("005", "a b cd efg")]])
    postings = ix.build_postings(n)
    found = {}
    for r in postings.collect():
        found.setdefault(r["token"], set()).add(r["id"])
    assert found["장학금"] == {"001", "003"} and found["신촌캠퍼스"] == {"001", "002", "003", "004", "005"}
    assert "the" not in found and "a" not in found and "b" not in found and found["fox"] == {"004"} and found["cd"] == {"005"}
    header = ix.index_header(postings, n).first()
    assert (header["version"], header["notice_count"], header["token_count"]) == (1, 5, len(found))
    assert rows(ix.search_ids(postings, "신청 장학금"), "id") == [("001",)]
    assert rows(ix.search_notices(postings, n, "the"), "id") == []
    blocks = ix.export_index(postings, max_ids=2).filter("token = '신촌캠퍼스'").collect()
    assert sorted(i for b in blocks for i in b["ids"]) == ["001", "002", "003", "004", "005"] and blocks[0]["blocks"] == 3
    assert all(list(b["ids"]) == sorted(b["ids"]) for b in blocks)


def test_token_cap_counts_repeats(spark):
    title = " ".join(["same"] * 30 + [f"w{i}" for i in range(40)])
    n = notices(spark, dict(id="1", notice_key="1", title=title))
    tokens = {r["token"] for r in ix.build_postings(n, IndexRules(max_tokens=50)).collect()}
    assert tokens == {"same"} | {f"w{i}" for i in range(20)}
    assert {r["token"] for r in ix.build_postings(n).collect()} >= {"same"} | {f"w{i}" for i in range(40)}
    assert {r["token"] for r in ix.build_postings(n, IndexRules(max_tokens=31)).collect()} == {"same", "w0"}


def test_sorted_postings_order(spark):
    n = numbered(spark, 200)
    out = ix.sorted_postings(ix.build_postings(n))
    parts = out.withColumn("p", F.spark_partition_id()).collect()
    got = [(r["token"], r["id"]) for r in sorted(parts, key=lambda r: r["p"])]
    assert got == sorted(got) and len(got) == len(set(got))


# Feed


def sample(spark):
    return notices(
        spark,
        dict(campus="A", department_name="d1", board_name="x", title="Hello World", date="2026-02-03"),
        dict(campus="A", department_name="d2", board_name="y", title="hello", date="2026-02-01", link="https://e/2"),
        dict(campus="B", department_name="d1", board_name="x", title="Other", date="", link="https://e/3"),
        dict(campus="B", department_name="d3", board_name="z", title="WORLD", date=None, college="k", link="https://e/4"))


def test_filters_and_order(spark):
    n = sample(spark)
    assert rows(fd.search_title(n, "  hello "), "title") == [("Hello World",), ("hello",)]
    assert fd.search_title(n, "   ").count() == 4 and fd.search_title(n, None).count() == 4
    assert rows(fd.apply_filters(n, "A", "", None, "WORLD"), "title") == [("Hello World",)]
    assert fd.apply_filters(n, campus="a").count() == 0
    newest = [r["date"] or "" for r in fd.sort_by_date(n).collect()]
    assert newest == ["2026-02-03", "2026-02-01", "", ""]
    assert [r["date"] or "" for r in fd.sort_by_date(n, newest_first=False).collect()] == newest[::-1]
    assert [r["title"] for r in fd.process_notices(n, limit=1).collect()] == ["Hello World"]


def test_facets_and_summary(spark):
    n = sample(spark)
    assert [r[0] for r in fd.facet_departments(n, "A").collect()] == ["d1", "d2"]
    assert [r[0] for r in fd.facet_boards(n, "B", "d1").collect()] == ["x"]
    got = fd.notice_stats(n).first()
    assert tuple(got) == (4, 2, 3, 3, 2)
    assert tuple(fd.date_range(n).first()) == ("2026-02-01", "2026-02-03")
    assert tuple(fd.date_range(n.limit(0)).first()) == ("", "") and fd.notice_stats(n.limit(0)).first()["total"] == 0


def test_null_is_one_value(spark):
    n = spark.createDataFrame([("a", "d", "b", None), ("a", "d", "b", ""), (None, "d", "-", "c")],
                              "campus string, department_name string, board_name string, college string")
    assert tuple(fd.notice_stats(n).first()) == (3, 2, 1, 2, 3)


def test_backfill_stops_at_the_gap(spark):
    hot = numbered(spark, 3, "2026-02-05")
    old = [sn.month_partition(numbered(spark, k, d), "2026-02-10") for k, d in
           [(2, "2026-01-09"), (4, "2025-12-01"), (5, "2025-10-01")]]
    archive = old[0].unionByName(old[1]).unionByName(old[2])
    assert fd.backfill_months(hot, archive) == [(2026, 1), (2025, 12)]
    assert fd.month_backfill(hot, archive).groupBy("page").count().orderBy("page").collect() == [(0, 3), (1, 2), (2, 4)]
    assert fd.month_backfill(hot, archive, steps=1).count() == 5
    assert fd.month_backfill(hot.limit(0), archive).count() == 0


def test_loaded_rows_are_left_out(spark):
    page = notices(spark, dict(link="l1"), dict(link="l1"), dict(link="l2"))
    loaded = notices(spark, dict(link="l2"))
    assert rows(fd.not_loaded(page, loaded), "link") == [("l1",), ("l1",)]


def test_nested_round_trip(spark):
    n = sample(spark)
    nested = fd.to_nested(n)
    assert nested.first()["metadata"]["pinned"] is False
    flat = fd.to_flat(nested)
    assert set(flat.columns) == {"id", "title", "link", "campus", "college", "department_name", "board_name", "date", "is_pinned"}
    assert rows(flat, "id", "title") == rows(n, "id", "title")


def test_feed_job(spark, tmp_path):
    root = str(tmp_path / "lake")
    commit(spark, root, "r1", numbered(spark, 12).unionByName(numbered(spark, 7, "2026-01-05")))
    assert feed(spark, root).notices.count() == 12
    both = feed(spark, root, months_back=None, limit=15)
    assert both.notices.count() == 15 and both.stats.first()["total"] == 19 and both.latest.first()["latest"] == "2026-02-02"


# Streams


def test_stream_of_runs_equals_batch(spark, tmp_path):
    src, root = str(tmp_path / "in"), str(tmp_path / "lake")
    runs = [numbered(spark, 100), numbered(spark, 50), numbered(spark, 95)]
    for run in runs:
        run.write.mode("append").parquet(src)
        stream = spark.readStream.schema(run.schema).parquet(src)
        incremental_commit(stream, root, str(tmp_path / "state"), "2026-02-10").awaitTermination()
    # Nothing new: no further run.
    incremental_commit(spark.readStream.schema(runs[0].schema).parquet(src), root, str(tmp_path / "state"),
                       "2026-02-10").awaitTermination()
    lake = NoticeLake(spark, root)
    assert rows(lake.manifest(), "seq", "status", "current_count") == [(0, "cold_start", 100), (1, "triggered", 50), (2, "safe", 95)]
    batch_root = str(tmp_path / "batch")
    for i, run in enumerate(runs):
        commit(spark, batch_root, f"r{i}", run)
    assert rows(lake.read_current(), "notice_key") == rows(NoticeLake(spark, batch_root).read_current(), "notice_key")


def test_empty_and_replayed_batches(spark, tmp_path):
    root = str(tmp_path / "lake")
    do = commit_batches(root, "2026-02-10", order=("link",))
    do(numbered(spark, 20).unionByName(numbered(spark, 20)), 0)
    do(numbered(spark, 0), 1)
    do(numbered(spark, 20), 0)
    assert rows(NoticeLake(spark, root).manifest(), "run_id", "current_count") == [("batch-000000000000", 20)]


def test_new_notice_feed(spark, tmp_path):
    src = str(tmp_path / "in")
    base = spark.range(6).selectExpr("concat('k', id % 4) notice_key", "timestamp'2026-01-01' + make_interval(0,0,0,0,0,id) crawled_at")
    base.write.parquet(src)
    q = (new_notice_feed(spark.readStream.schema(base.schema).parquet(src)).writeStream.format("memory")
         .queryName("fresh").trigger(availableNow=True).start())
    q.awaitTermination()
    assert rows(spark.table("fresh"), "notice_key") == [("k0",), ("k1",), ("k2",), ("k3",)]


def test_config_validation():
    ok = Config(campuses=(SeedCampus("c", "http://u"),))
    assert ok.validate() is ok
    with pytest.raises(ValueError):
        Config().validate()
