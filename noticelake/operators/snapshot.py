"""Comparing runs: change feed, drop guard, month partitions, archive merge."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticelake.config import Breaker
from noticelake.functions.dates import archive_day
from noticelake.operators.dedupe import join_dimension
from noticelake.session import scratch_path

ADDED, UPDATED, REMOVED = "added", "updated", "removed"


def changed_keys(
    previous: DataFrame, current: DataFrame, columns: Sequence[str] = (), key: str = "notice_key"
) -> DataFrame:
    """``(key, change)`` of keys that are new, gone, or whose ``columns`` differ.

    One shuffle of keys and hashes (96 bits, nulls told apart); the columns themselves stay where
    they are. Keys must be unique per run and not null: a key that is not fails the job, found by
    the same aggregation.
    """
    parts = [p for c in columns for p in (F.col(c), F.isnull(c))] or [F.lit(0)]

    def side(rows: DataFrame, now: bool) -> DataFrame:
        return rows.select(
            key, F.lit(now).alias("now"), F.xxhash64(*parts).alias("a"), F.hash(*parts).alias("b")
        )

    per_key = side(previous, False).unionByName(side(current, True)).groupBy(key).agg(
        F.count_if(~F.col("now")).alias("old"),
        F.count_if("now").alias("new"),
        ((F.min("a") != F.max("a")) | (F.min("b") != F.max("b"))).alias("differs"),
    )
    broken = (F.col("old") > 1) | (F.col("new") > 1) | F.col(key).isNull()
    shown = F.coalesce(F.col(key), F.lit("NULL"))
    change = (
        F.when(broken, F.raise_error(F.concat(F.lit("not one notice per key: "), shown)))
        .when(F.col("old") == 0, ADDED)
        .when(F.col("new") == 0, REMOVED)
        .when(F.col("differs"), UPDATED)
    )
    return per_key.select(key, change.alias("change")).filter("change IS NOT NULL")


def change_feed(
    previous: DataFrame,
    current: DataFrame,
    detect_updates: bool = True,
    key: str = "notice_key",
) -> DataFrame:
    """Current rows that are new or retitled, and keys that are gone.

    ``change`` plus the columns of ``current``; a removed notice has only its key (and ``id``
    where both sides have one). Two phases: changed keys are found on keys and hashes of titles
    and written, then only their rows are fetched: the keys travel to the rows while their number
    is within the bound of ``join_dimension``, so unchanged rows meet no shuffle.
    """
    spark = current.sparkSession
    path = scratch_path(spark, "changed")
    changed_keys(previous, current, ["title"] if detect_updates else [], key).write.parquet(
        path, compression="zstd")
    keys = spark.read.parquet(path)
    here = join_dimension(current, keys.filter(F.col("change") != REMOVED), key, "inner")
    gone = keys.filter(F.col("change") == REMOVED)
    if "id" in previous.columns and "id" in current.columns and key != "id":
        gone = join_dimension(previous.select(key, "id"), gone, key, "inner")
    return here.unionByName(gone, allowMissingColumns=True).select("change", *current.columns)


def all_added(current: DataFrame, key: str = "notice_key") -> DataFrame:
    """The change feed of a first run, whose keys are unique: every row is new, no row meets a shuffle.
    A null key fails the job as in ``changed_keys``."""
    known = F.when(F.col(key).isNull(), F.raise_error(F.lit("not one notice per key: NULL"))).otherwise(ADDED)
    return current.select(known.cast("string").alias("change"), *current.columns)


def change_counts(changes: DataFrame) -> DataFrame:
    """One row: ``added, updated, removed, change_count, has_changes``."""
    counts = changes.agg(
        *[F.count_if(F.col("change") == c).alias(c) for c in (ADDED, UPDATED, REMOVED)]
    )
    total = F.col(ADDED) + F.col(UPDATED) + F.col(REMOVED)
    return counts.withColumn("change_count", total).withColumn(
        "has_changes", F.col("change_count") > 0
    )


def unchanged_ids(previous: DataFrame, current: DataFrame, key: str = "notice_key") -> DataFrame:
    """Keys in both runs."""
    return current.select(key).join(previous.select(key), key, "left_semi")


def only_in(left: DataFrame, right: DataFrame, key: str = "notice_key") -> DataFrame:
    """Rows of ``left`` whose key ``right`` does not have."""
    return left.join(right.select(key), key, "left_anti")


def drop_percent(current: Column, previous: Column) -> Column:
    """Loss against the previous count in percent; 0 where nothing was lost."""
    lost = (previous - current).cast("double") / previous.cast("double") * 100.0
    return F.when(current < previous, lost).otherwise(F.lit(0.0))


def breaker_status(current: Column, previous: Column, rules: Breaker = Breaker()) -> Column:
    cold = (previous == 0) & F.lit(rules.allow_cold_start)
    return (
        F.when((current == 0) & cold, "cold_start")
        .when(current == 0, "empty_result")
        .when(previous < rules.min_baseline, "cold_start")
        .when(drop_percent(current, previous) > rules.max_drop_percent, "triggered")
        .otherwise("safe")
    )


def breaker_verdict(counts: DataFrame, rules: Breaker = Breaker()) -> DataFrame:
    """Add ``status, drop_percent, proceed`` to rows of ``current_count, previous_count``."""
    cur, prev = F.col("current_count"), F.col("previous_count")
    return (
        counts.withColumn("status", breaker_status(cur, prev, rules))
        .withColumn("drop_percent", drop_percent(cur, prev))
        .withColumn("proceed", F.col("status").isin("safe", "cold_start"))
    )


def circuit_breaker(
    current: DataFrame, previous: DataFrame, rules: Breaker = Breaker()
) -> DataFrame:
    """Verdict on two runs. Both are counted in one aggregation over their union."""
    sides = current.select(F.lit(1).alias("side")).unionByName(
        previous.select(F.lit(0).alias("side"))
    )
    counts = sides.agg(
        F.count_if(F.col("side") == 1).alias("current_count"),
        F.count_if(F.col("side") == 0).alias("previous_count"),
    )
    return breaker_verdict(counts, rules)


def month_partition(notices: DataFrame, as_of: str, date: str = "date") -> DataFrame:
    """Add ``year, month, is_hot`` from the normalised date. Unreadable dates belong to the
    month of ``as_of``; every other month, also a future one, is cold."""
    day = archive_day(F.col(date), as_of)
    this_month = F.trunc(F.lit(as_of).cast("date"), "MM")
    return notices.withColumns(
        {
            "year": F.year(day),
            "month": F.month(day),
            "is_hot": F.trunc(day, "MM") == this_month,
        }
    )


def month_counts(notices: DataFrame) -> DataFrame:
    return notices.groupBy("year", "month", "is_hot").agg(F.count("*").alias("notices"))


def new_for_archive(incoming: DataFrame, archive: DataFrame, key: str = "notice_key") -> DataFrame:
    """Incoming rows whose key their archive month does not have: first write wins."""
    on = ["year", "month", key]
    return incoming.join(archive.select(*on), on, "left_anti")
