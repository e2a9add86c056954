"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Every query is run to completion into a discarding sink, so all columns of all
rows are computed.  One untimed pass warms the JVM; the better of two timed
passes counts.  What a pass held or wrote is let go before the next one begins,
so that no pass reads another one's results.
"""

from __future__ import annotations

import json
import os
import re
import sys
import tempfile
import time
from pathlib import Path

from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent))

from hushscan.operators.cluster import release  # noqa: E402
from hushscan.plans.registry import QUERIES  # noqa: E402

HEADLINE = (
    "detect_counts_by_kind",
    "labeled_values",
    "url_masked_text",
    "redacted_documents",
    "redacted_events",
    "custom_rule_findings",
    "inline_unsuppressed",
    "baseline_new_findings",
    "history_first_seen",
    "scan_summary",
    "sarif_results",
    "credentials",
    "leftover_references",
    "lines_with_literals",
    "lines_with_many_literals",
    "scrubbed_events",
    "history_references",
    "rotation_worklist",
    "fix_plan",
    "line_reassembly",
    "stream_findings",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 4))
    chosen = sys.argv[1:] or HEADLINE
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("hushscan-bench")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="hushscan-bench-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    def run(name: str) -> float:
        release(spark)
        spark.catalog.clearCache()
        began = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - began

    run("detect_counts_by_kind")
    seconds = {name: round(min(run(name), run(name)), 3) for name in chosen}
    scale = re.search(r"sf([0-9.]+)", sf_dir)
    print(
        json.dumps(
            {
                "metric": "headline query time",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(scale.group(1)) if scale else None,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
