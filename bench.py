"""Time the headline queries and print one JSON line.

BENCH_SF_DIR and BENCH_CPUS choose data and cores; each query runs once to warm up and then
three times into a sink that discards rows, and the median counts.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from ledgerspark import build_session  # noqa: E402
from queries import QUERIES  # noqa: E402

HEADLINE = (
    "annual_summary",
    "facts_latest_filing",
    "growth_yoy",
    "dq_report_raw",
    "interval_changes",
    "html_text",
    "section_extract",
    "chunks_overlap",
    "term_stats",
    "retrieve_topk",
    "retrieve_conversations",
    "question_metrics",
    "question_figures",
    "answer_texts",
    "chunk_topics",
    "clean_text",
)
RUNS = 3


def run(spark, name: str, sf_dir: str) -> float:
    begin = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - begin


def report(seconds: dict[str, float], sf_dir: str) -> str:
    return json.dumps(
        {
            "metric": "headline_queries_total",
            "value": round(sum(seconds.values()), 3),
            "unit": "sec",
            "queries": seconds,
            "sf": os.path.basename(os.path.normpath(sf_dir)).removeprefix("sf"),
        }
    )


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = build_session(
        app_name="bench",
        master=f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": str(2 * int(cpus)),
            # the test tables are one small file each
            "spark.ledgerspark.scanPartitions": cpus,
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "12g"),
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds: dict[str, float] = {}
    for name in names:
        run(spark, name, sf_dir)
        seconds[name] = round(statistics.median(run(spark, name, sf_dir) for _ in range(RUNS)), 3)
        # the figures so far, should a later query not end
        print(report(seconds, sf_dir), file=sys.stderr, flush=True)
    print(report(seconds, sf_dir), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
