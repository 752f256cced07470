"""Runs arriving as a stream: incremental commit, new-notice feed, normalising."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from noticelake.config import Breaker, Cleaning, CommitOptions, IndexRules
from noticelake.functions.dates import normalize_date
from noticelake.functions.ids import extract_notice_id
from noticelake.functions.text import clean_date, clean_title
from noticelake.operators.dedupe import first_per_key
from noticelake.operators.rows import identify
from noticelake.plans.commit import commit_snapshot
from noticelake.session import scratch_path
from noticelake.streaming.seen import SeenKeys


def normalize_stream(raw: DataFrame, cleaning: Cleaning) -> DataFrame:
    """Raw notices (``raw_title, raw_date, link``...) cleaned, dated and identified.

    Stateless column work, the same for a stream and a table. Rows without a title go.
    """
    cleaned = (
        raw.withColumn("title", clean_title(F.col("raw_title"), cleaning))
        .withColumn("date", normalize_date(clean_date(F.col("raw_date"), cleaning)))
        .withColumn("source_id", extract_notice_id(F.col("link")))
        .filter("title <> ''")
        .drop("raw_title", "raw_date")
    )
    return identify(cleaned)


def commit_batches(
    root: str,
    as_of: str | Callable[[int], str],
    options: CommitOptions = CommitOptions(),
    breaker: Breaker = Breaker(),
    index_rules: IndexRules = IndexRules(),
    order: tuple[str, ...] | None = None,
) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function: each run of a micro-batch is committed for itself.

    Rows with a ``run_id`` column belong to that run, and runs are committed in the order of
    their ids. Without the column a batch is one run, named by the batch id. Either way a
    batch that is replayed after a failure is recognised in the manifest. A batch without rows
    is no run; taken for one, it would trip the guard.
    """

    def commit(batch: DataFrame, batch_id: int) -> None:
        if "run_id" in batch.columns:
            # One short text per run that arrived since the last trigger.
            runs = sorted(r["run_id"] for r in batch.select("run_id").distinct().collect())
            parts = [(run, batch.filter(F.col("run_id").eqNullSafe(run)).drop("run_id")) for run in runs]
        else:
            parts = [] if batch.isEmpty() else [(f"batch-{batch_id:012d}", batch)]
        for run, rows in parts:
            commit_snapshot(
                batch.sparkSession, rows, root, run, as_of(batch_id) if callable(as_of) else as_of,
                options, breaker, index_rules, order=order,
            )

    return commit


def incremental_commit(
    stream: DataFrame,
    root: str,
    checkpoint: str,
    as_of: str | Callable[[int], str],
    **commit_settings,
) -> StreamingQuery:
    """Commit every arriving run against the last snapshot, then stop when all are read."""
    return (
        stream.writeStream.foreachBatch(commit_batches(root, as_of, **commit_settings))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def new_notice_feed(
    stream: DataFrame,
    key: tuple[str, ...] = ("notice_key",),
    event_time: str = "crawled_at",
    delay: str = "30 days",
) -> DataFrame:
    """Rows whose key was not seen within ``delay``: state is bounded by the watermark."""
    timed = stream.withColumn(event_time, F.col(event_time).cast("timestamp"))
    return timed.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(list(key))


def exact_new_notices(
    spark: SparkSession, batch: DataFrame, seen_path: str, key: str = "notice_key",
    before: int | None = None,
) -> DataFrame:
    """Rows of a batch whose key the ``seen_path`` table lacks, each key once; for use in
    ``foreachBatch`` where no horizon may be assumed, so late rows count like all others. An absent
    table has seen nothing. With ``before`` only keys of earlier batches count. A null key is never
    taken for a seen one."""
    fresh = first_per_key(batch, [key], [F.xxhash64(*batch.columns)])
    known = SeenKeys(spark, seen_path, batch.schema[key]).known(fresh.select(key), before)
    return fresh.join(known, key, "left_anti").select(*batch.columns)


def exact_feed(out_path: str, seen_path: str, key: str = "notice_key") -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function that adds new rows to ``out_path`` and their keys to ``seen_path``.

    Both go to a folder of the batch, the keys last. A replayed batch looks at the keys of earlier
    batches only and overwrites its own folders, so it writes the same rows again.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        # Read twice below, so a batch from a source that cannot be read twice is written first.
        path = scratch_path(spark, "batch")
        batch.write.parquet(path)
        rows = spark.read.schema(batch.schema).parquet(path)
        seen = SeenKeys(spark, seen_path, batch.schema[key])
        seen.merge(batch_id)
        out = f"{out_path}/batch={batch_id}"
        exact_new_notices(spark, rows, seen_path, key, before=batch_id).write.mode("overwrite").parquet(out)
        added = spark.read.schema(batch.schema).parquet(out).select(key).filter(F.col(key).isNotNull())
        seen.add(added, batch_id, batch_id + 1)

    return write
