"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from crawlweave.plans.catalog import QUERIES
from crawlweave.session import build_session

HEADLINE = (
    "page_dataset page_links link_graph page_headings page_lists domain_report process_records clean_content "
    "entities_raw contact_index keywords_topk keywords_by_source document_frequency content_dedupe corpus_stats "
    "language_report url_clean_dedupe task_build job_progress job_stats worker_distribution job_task_join job_report "
    "cancel_job_tasks cascade_delete latest_status histogram percentiles success_rate error_alert ema source_health "
    "token_bucket ttl_cache word_search passage_search semantic_topk stream_success_rate"
).split()


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__ui__enabled="false",
        spark__driver__memory="12g", spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE
    spark.read.parquet(f"{sf}/pages.parquet").write.format("noop").mode("overwrite").save()  # start-up is not a query
    times: dict[str, float] = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    pages = spark.read.parquet(f"{sf}/pages.parquet").count()
    rates = {}
    if "page_dataset" in times:
        rates["pages_per_sec_extract"] = round(pages / times["page_dataset"], 1)
    if "process_records" in times:
        docs = spark.read.parquet(f"{sf}/documents.parquet").count()
        rates["documents_per_sec_process"] = round(docs / times["process_records"], 1)
    if "job_progress" in times:
        rates["tasks_per_sec_progress"] = round(spark.read.parquet(f"{sf}/events.parquet").count() / times["job_progress"], 1)
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": sf.rstrip("/").rsplit("sf", 1)[-1], "cpus": int(cpus), "rates": rates,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
