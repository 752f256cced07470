"""Headline queries at one scale, each run to the end; one JSON line on stdout."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from noticelake.catalog.queries import QUERIES  # noqa: E402
from noticelake.session import build_session  # noqa: E402

HEADLINE = (
    "q01_feed q01b_feed_asc q02_facets q03_notice_stats q03b_date_range q04_normalize_dates "
    "q05_canonical_id q06_dedupe_first q07_change_feed q08_circuit_breaker q09_month_partition "
    "q10_archive_merge q11_month_backfill q12_inverted_index q12b_index_documents "
    "q12c_document_frequency q13_index_search q14_extract_links q15_dedupe_links "
    "q16_keyword_boards q17_detect_cms q18_heading_segments q19_merge_sources q20_classify_fetch "
    "q21_run_stats q22_hierarchy q23_clean_text q24_manual_review q25b_stream_normalize "
    "q26_extract_rows q27_commit q28d_crawl_notices"
).split()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus,
        spark__ui__enabled="false",
        spark__driver__memory="16g",
    )
    spark.sparkContext.setLogLevel("OFF")
    spark.read.parquet(f"{sf_dir}/orders.parquet").count()
    seconds, failed = {}, {}
    for name in HEADLINE:
        started = time.perf_counter()
        try:
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - started, 3)
        except Exception as error:  # a failing query must not hide the others
            failed[name] = str(error)[:200]
    line = {
        "metric": "total wall time of the headline queries",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")),
    }
    if failed:
        line["failed"] = failed
    print(json.dumps(line), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
