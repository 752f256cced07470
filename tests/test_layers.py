"""The index in layers, the diff in two phases, and counts taken while writing."""

import random

import pytest
from fixtures import keyed, notices, numbered, rows
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from noticelake.config import CommitOptions, IndexRules
from noticelake.operators import index as ix
from noticelake.operators import snapshot as sn
from noticelake.plans.commit import commit_snapshot, update_index
from noticelake.schemas import INDEX_DOCS
from noticelake.sources.lake import NoticeLake, write_counted

FORCE = CommitOptions(force=True, calculate_diff=False)


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def postings_of(frame):
    return rows(ix.build_postings(frame), "token", "notice_key", "id")


@pytest.mark.parametrize("sizes, start", [
    ([5], 0), ([100, 5], 1), ([100, 50], 1), ([100, 51], 0), ([100, 20, 11], 1), ([100, 20, 9, 5], 1),
    ([100, 20, 4, 3], 2), ([100, 0], 1), ([0, 0], 1), ([1000, 100, 40, 15, 8], 1),
])
def test_first_to_merge(sizes, start):
    assert ix.first_to_merge(sizes) == start


def test_layers_equal_a_full_rebuild(spark, tmp_path):
    """Random runs: keys come, go, come back and change in any indexed column."""
    lake, seed = NoticeLake(spark, str(tmp_path / "lake")), random.Random(7)
    words = ["alpha", "beta", "gamma", "delta", "공지"]
    state, deepest = {}, 0
    for run in range(7):
        for _ in range(40 if run == 0 else seed.choice([1, 2, 4, 25])):
            k = str(seed.randrange(60))
            if k in state and seed.random() < 0.3:
                del state[k]
            else:
                state[k] = dict(id=f"i{k}", notice_key=k, title=" ".join(seed.choices(words, k=3)),
                                board_name=seed.choice(["Board", "Other", None]))
        frame = notices(spark, *state.values())
        row = commit_snapshot(spark, frame, lake.root, f"r{run}", "2026-02-10", FORCE)
        want = postings_of(frame)
        assert rows(lake.read_index(), "token", "notice_key", "id") == want
        assert (row["index_notice_count"], row["index_token_count"]) == (len(state), len({t for t, *_ in want}))
        deepest = max(deepest, len(row["index_layers"]))
    assert deepest > 1


def test_a_run_without_change_writes_no_postings(spark, tmp_path):
    lake = NoticeLake(spark, str(tmp_path / "lake"))
    first = commit_snapshot(spark, numbered(spark, 30), lake.root, "r1", "2026-02-10")
    again = commit_snapshot(spark, numbered(spark, 30), lake.root, "r2", "2026-02-10")
    fields = ("index_layers", "index_notice_count", "index_token_count", "index_rules")
    assert [first[f] for f in fields] == [again[f] for f in fields]
    assert not (tmp_path / "lake/index/run=r2/new/postings").exists()
    # One more notice is one small layer.
    more = commit_snapshot(spark, numbered(spark, 31), lake.root, "r3", "2026-02-10")
    assert [(at.folder, at.docs, at.dead) for at in more["index_layers"]] == [("run=r1/new", 30, 0), ("run=r3/new", 1, 0)]
    assert "dead" not in plan(lake.read_index())


def test_layers_start_anew(spark, tmp_path):
    lake = NoticeLake(spark, str(tmp_path / "lake"))
    frame = keyed(spark, ("1", "one two three"), ("2", "four"))
    commit_snapshot(spark, frame, lake.root, "r1", "2026-02-10")
    cut = commit_snapshot(spark, frame, lake.root, "r2", "2026-02-10", index_rules=IndexRules(max_tokens=1))
    assert len(cut["index_layers"]) == 1 and rows(lake.read_index(), "token") == [("four",), ("one",)]
    none = commit_snapshot(spark, frame, lake.root, "r3", "2026-02-10", CommitOptions(generate_index=False))
    assert none["index_layers"] is None and lake.read_index() is None
    commit_snapshot(spark, frame, lake.root, "r4", "2026-02-10")
    assert rows(lake.read_index(), "token", "notice_key", "id") == postings_of(frame)


def test_a_dead_run_leaves_no_layer(spark, tmp_path):
    lake = NoticeLake(spark, str(tmp_path / "lake"))
    frame = keyed(spark, *[(str(i), f"title {i}") for i in range(20)])
    commit_snapshot(spark, frame, lake.root, "r1", "2026-02-10")
    changed = keyed(spark, *[(str(i), f"other {i}") for i in range(20)])
    update_index(lake, changed.select(*INDEX_DOCS.names), lake.latest(), "r2", IndexRules())  # no manifest row
    assert rows(lake.read_index(), "token", "notice_key", "id") == postings_of(frame)
    commit_snapshot(spark, changed, lake.root, "r2", "2026-02-10")
    assert rows(lake.read_index(), "token", "notice_key", "id") == postings_of(changed)


def test_token_filter_reaches_every_layer(spark, tmp_path):
    lake = NoticeLake(spark, str(tmp_path / "lake"))
    commit_snapshot(spark, keyed(spark, *[(str(i), f"title {i}") for i in range(20)]), lake.root, "r1", "2026-02-10")
    commit_snapshot(spark, keyed(spark, *[(str(i), f"title {i + (i == 3)}") for i in range(20)]), lake.root, "r2", "2026-02-10")
    assert len(lake.latest()["index_layers"]) == 2
    text = plan(ix.search_ids(lake.read_index(), "title"))
    assert text.count("PushedFilters: [IsNotNull(token), EqualTo(token,title)]") == 2
    assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text


def test_archive_in_the_index_once(spark, tmp_path):
    lake = NoticeLake(spark, str(tmp_path / "lake"))
    options = CommitOptions(index_archive=True, force=True)
    # A date that cannot be read puts the key into the month of each run that lost it.
    lost = notices(spark, dict(id="a", notice_key="a", title="lost one", date="soon"))
    kept = notices(spark, dict(id="b", notice_key="b", title="kept one", date="2026-04-01"))
    for run, as_of, frame in (("r1", "2026-02-10", lost), ("r2", "2026-03-10", kept), ("r3", "2026-04-10", lost),
                              ("r4", "2026-05-10", kept)):
        commit_snapshot(spark, frame, lake.root, run, as_of, options)
    assert lake.archive().filter("notice_key = 'a'").count() == 2
    assert rows(ix.search_ids(lake.read_index(), "one"), "notice_key") == [("a",), ("b",)]


# Diff


def test_changed_keys(spark):
    before = notices(spark, dict(id="1", notice_key="1", title=None), dict(id="2", notice_key="2", author="x"),
                     dict(id="3", notice_key="3"))
    now = notices(spark, dict(id="1", notice_key="1", title=""), dict(id="2", notice_key="2", author="y"),
                  dict(id="4", notice_key="4"))
    both = [("3", "removed"), ("4", "added")]
    assert sorted(rows(sn.changed_keys(before, now), "notice_key", "change")) == both
    assert rows(sn.changed_keys(before, now, ["title"]), "notice_key", "change") == [("1", "updated"), *both]
    assert rows(sn.changed_keys(before, now, ["title", "author"]), "notice_key", "change") == [
        ("1", "updated"), ("2", "updated"), *both]
    # Values do not slip from one column into the next.
    a, b = notices(spark, dict(id="1", notice_key="1", title="x", author=None)), notices(
        spark, dict(id="1", notice_key="1", title=None, author="x"))
    assert sn.changed_keys(a, b, ["title", "author"]).count() == 1


@pytest.mark.parametrize("broken", [[("1", "A"), ("1", "B")], [("1", "A"), (None, "B")]])
def test_repeated_or_absent_keys_fail(spark, broken):
    good = keyed(spark, ("1", "A"))
    bad = notices(spark, *[dict(id="x", notice_key=k, title=t) for k, t in broken])
    for pair in ((good, bad), (bad, good)):
        with pytest.raises(PySparkException, match="not one notice per key"):
            sn.change_feed(*pair)


def test_titles_of_unchanged_notices_meet_no_shuffle(spark, tmp_path):
    for name, frame in (("before", numbered(spark, 50)), ("now", numbered(spark, 52))):
        frame.write.parquet(str(tmp_path / name))
    before, now = (spark.read.parquet(str(tmp_path / n)) for n in ("before", "now"))
    text = plan(sn.change_feed(before, now))
    assert "hashpartitioning" not in text and text.count("BroadcastHashJoin") == 2
    keys = sn.changed_keys(before, now, ["title"])
    exchanged = [line for line in keys._jdf.queryExecution().toString().splitlines() if "partial_" in line]
    assert exchanged and all("title" not in line for line in exchanged)


# Counts


def test_counts_while_writing(spark, tmp_path):
    path = str(tmp_path / "t")
    counts = dict(all_=F.count(F.lit(1)), odd=F.count_if(F.expr("id % 2 = 1")))
    assert write_counted(spark.range(11).toDF("id"), path, **counts) == {"all_": 11, "odd": 5}
    assert write_counted(spark.range(0).toDF("id"), path, **counts) == {"all_": 0, "odd": 0}
    assert write_counted(spark.createDataFrame([], "id long"), path, **counts) == {"all_": 0, "odd": 0}
    assert write_counted(spark.range(9).filter("false").toDF("id"), path, **counts) == {"all_": 0, "odd": 0}
    assert spark.read.parquet(path).count() == 0


def test_postings_point_to_numbers(spark, tmp_path):
    """No posting carries the key of its notice, in a new layer or a merged one."""
    lake = NoticeLake(spark, str(tmp_path / "lake"))
    commit_snapshot(spark, keyed(spark, *[(str(i), f"title {i}") for i in range(20)]), lake.root, "r1", "2026-02-10", FORCE)
    changed = keyed(spark, *[(str(i), f"other {i}") for i in range(20)])
    row = commit_snapshot(spark, changed, lake.root, "r2", "2026-02-10", FORCE)
    for folder in ["run=r1/new", *(at.folder for at in row["index_layers"])]:
        assert spark.read.parquet(f"{lake.root}/index/{folder}/postings").columns == ["token", "doc"]
    assert rows(lake.read_index(), "token", "notice_key", "id") == postings_of(changed)


def test_a_first_run_compares_nothing(spark, tmp_path):
    lake = NoticeLake(spark, str(tmp_path / "lake"))
    row = commit_snapshot(spark, numbered(spark, 7), lake.root, "r1", "2026-02-10")
    assert (row["added"], row["updated"], row["removed"]) == (7, 0, 0)
    assert {r["change"] for r in lake.read_changes().collect()} == {"added"}
    assert "Exchange" not in plan(sn.all_added(lake.read_snapshot()))
    lost = notices(spark, dict(id="x", notice_key=None, title="t"), dict(id="y", notice_key="y"))
    with pytest.raises(PySparkException, match="not one notice per key"):
        commit_snapshot(spark, lost, str(tmp_path / "other"), "r1", "2026-02-10")
