"""Headline timings over a log of the given tables; prints one JSON line.

The log is ``events`` and ``lineitem`` rendered as text files.  ``ingest`` reads the text, classifies
the lines, groups them into records and writes the table the other queries run on.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumberline.catalog.base import EVENT_SCHEMA
from lumberline.functions.detect import classify
from lumberline.functions.rules import Rule
from lumberline.operators import directory, extract, filters, insights, order, payloads, records, stats, tokens
from lumberline.operators.filters import FilterSpec
from lumberline.plans.importers import PRESETS
from lumberline.session import checkpoint_dir, local_session
from lumberline.sources import files, views

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "3"))
SCANNED_FILES = 1000


def run(frame: DataFrame) -> None:
    frame.write.format("noop").mode("overwrite").save()


def timed(action: Callable[[], object], runs: int = RUNS) -> float:
    """Median of some runs after one that warms up."""
    action()
    taken = []
    for _ in range(runs):
        began = time.perf_counter()
        action()
        taken.append(time.perf_counter() - began)
    return statistics.median(taken)


def prepare(spark: SparkSession, folder: str) -> int:
    """Write the text logs, and many small files for the directory scan; not timed."""
    events, threads = views.event_lines(spark, SF_DIR), views.thread_lines(spark, SF_DIR)
    events.orderBy("file_path", "seq").select("text").write.text(f"{folder}/text/events")
    threads.select("text").repartition(8).write.text(f"{folder}/text/threads")
    events.select("text").repartition(SCANNED_FILES).write.text(f"{folder}/many")
    return files.read_lines(spark, f"{folder}/text").count()


def main() -> None:
    spark = local_session(CPUS, "lumberline-bench", partitions=int(CPUS))
    spark.sparkContext.setLogLevel("ERROR")
    folder = f"{checkpoint_dir(spark).rstrip('/')}/bench-{uuid.uuid4().hex}"
    n_lines = prepare(spark, folder)

    def ingest() -> None:
        files.ingest_log(spark, f"{folder}/text", f"{folder}/log-{uuid.uuid4().hex}", by_date=False)

    seconds = {"ingest": timed(ingest)}
    stored = f"{folder}/log"
    log = files.ingest_log(spark, f"{folder}/text", stored, by_date=False)
    threads, events = log.where(F.col("file_path").contains("/threads/")), log.where(F.col("file_path").contains("/events/"))
    three = FilterSpec(levels=["WARN", "ERROR", "FATAL"], start="1996-01-01 00:00:00", end="2024-02-20 00:00:00",
                       rules=[Rule("qty 1"), Rule("worker-3"), Rule(r"value=\d{2}\.", regex=True, connector="or")])
    queries: dict[str, Callable[[], DataFrame]] = {
        "classify_and_group": lambda: files.read_log(spark, f"{folder}/text"),
        "extract_full": lambda: extract.extract_fields(events, EVENT_SCHEMA),
        "extract_degraded": lambda: extract.extract_fields(threads, PRESETS["classic"]),
        "filter_3_rules": lambda: filters.apply_filters(log, three),
        "search_positions": lambda: filters.search(log, [Rule("worker-7] error")]),
        "row_numbers": lambda: order.with_row_no(log.select(*order.POSITION)),
        "order": lambda: order.ordered(log),
        "records": lambda: records.assemble_records(log),
        "record_chunks": lambda: records.record_chunks(log),
        "json_blocks": lambda: payloads.line_json_blocks(events),
        "levels": lambda: stats.level_counts(log),
        "templates_top10": lambda: stats.top_messages(log),
        "timeline": lambda: stats.timeline(log),
        "insights": lambda: insights.insights(log),
        "file_breakdown": lambda: stats.file_breakdown(log),
        "token_counts": lambda: tokens.token_counts(events),
        "directory_scan": lambda: directory.scan_directory(classify(files.read_lines(spark, f"{folder}/many"))),
    }
    for name, build in queries.items():
        seconds[name] = timed(lambda build=build: run(build()))
        print(f"{name}: {seconds[name]:.2f}s", file=sys.stderr, flush=True)

    rates = {f"{q}_lines_per_sec": round(n_lines / seconds[q]) for q in ("ingest", "classify_and_group")}
    print(json.dumps({
        "metric": "total of medians", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": {k: round(v, 3) for k, v in seconds.items()}, "sf": os.path.basename(SF_DIR.rstrip("/")),
        "lines": n_lines, **rates, "files_per_sec": round(SCANNED_FILES / seconds["directory_scan"]),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
