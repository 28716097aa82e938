"""Headline queries (warm, medians) at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from statistics import median

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from glintscan.queries import QUERIES  # noqa: E402
from glintscan.session import build_session  # noqa: E402

HEADLINE = [
    "kw_config_order",
    "kw_longest_first",
    "kw_overlapping",
    "kw_many_terms",
    "check_content",
    "nested_hits",
    "chunked_check",
    "match_distinct_text",
    "top_terms",
    "run_summary",
    "token_clean",
    "xml_clean",
    "word_chunks",
    "mime_cascade",
    "signature_match",
    "archive_members",
    "dedup_keep_first",
    "row_cap",
    "running_counts",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = build_session(
        "glintscan-bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "16g"),
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.log.level": "ERROR",
            "spark.checkpoint.dir": tempfile.mkdtemp(prefix="bench-"),
        },
    )
    spark.range(1000).selectExpr("sum(id)").collect()  # start the executors

    def run(name: str) -> float:
        began = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - began

    run(names[0])  # warm-up, not counted
    rounds = int(os.environ.get("BENCH_ROUNDS", "3"))
    seconds: dict[str, float] = {}
    for name in names:
        seconds[name] = round(median(run(name) for _ in range(rounds)), 3)
        print(f"{name}: {seconds[name]}", file=sys.stderr)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total seconds of the headline queries, medians of three runs",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": sf_dir.rstrip("/").rpartition("sf")[2],
            }
        )
    )


if __name__ == "__main__":
    main()
