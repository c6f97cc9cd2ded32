"""Seconds of the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS], as one JSON line.

The session is warmed up by a scan and a small replay; each query then runs twice and its quicker run counts.
"""

import json
import os
import time

from pyspark.sql import SparkSession

from quillspan.plans.queries import QUERIES

HEADLINE = ("scan_event_counts", "request_windows", "five_way_counts", "fifo_match_requests", "session_indicators", "selection_outcomes", "transition_counts_all", "early_late_change", "outcomes_by_group", "session_features", "lifecycle_episodes")


def main() -> None:
    sf, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")

    def run(name: str) -> float:
        began = time.time()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        return time.time() - began

    for name in ("scan_event_counts", "lifecycle_episodes"):
        run(name)
    seconds = {name: round(min(run(name), run(name)), 3) for name in HEADLINE}
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
