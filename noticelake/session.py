"""Session defaults, and the shared scratch folder used for written hand-over tables."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app_name: str = "noticelake", master: str | None = None, **conf) -> SparkSession:
    """A session with the settings the jobs rely on; cluster sizing stays with the cluster."""
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # Pages can be megabytes each: keep Arrow batches of html small.
        .config("spark.sql.execution.arrow.maxRecordsPerBatch", "512")
        # Recording a source line per column costs seconds in plans with long expressions.
        .config("spark.sql.dataFrameQueryContext.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), str(value))
    return builder.getOrCreate()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under ``spark.checkpoint.dir``.

    The cluster names that folder, so tables written there outlive lost executors. Only where
    no folder is named (tests on one machine) is a temporary one made.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="noticelake-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def spread(df: DataFrame) -> DataFrame:
    """Input with fewer partitions than cores, spread over all cores.

    For small tables in one file, ahead of work that costs more than moving the rows. A table
    with enough partitions passes unchanged, so at scale this adds no shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


#: Rows and bytes of an Arrow batch of html, and rows of a batch of the Parquet reader, at most. Pages can be
#: megabytes each, and a task holds a batch as a whole.
BATCHES = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": 512,
    "spark.sql.execution.arrow.maxBytesPerBatch": 8 << 20,
    "spark.sql.parquet.columnarReaderBatchSize": 256,
}


def bound_batches(spark: SparkSession) -> None:
    """Lower the session's limits on batches where they are above those for html."""
    for name, most in BATCHES.items():
        if not 0 < int(re.sub(r"[bB]$", "", spark.conf.get(name))) <= most:
            spark.conf.set(name, str(most))


def deals(spark: SparkSession) -> int:
    """Partitions for rows that cost far more than their bytes: a few tasks per core.

    A number given to ``repartition`` also keeps small shuffles from being merged into few tasks.
    """
    return 4 * spark.sparkContext.defaultParallelism
