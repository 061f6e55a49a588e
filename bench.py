"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import statistics
import time

from rivulet.plans.queries import QUERIES
from rivulet.session import session

HEADLINE = [
    "wordcount_final", "running_sum", "running_maxby", "tumbling_agg", "sliding_agg", "session_fixed", "count_tumbling",
    "count_sliding", "window_all_topn", "keyed_connect", "window_join_left", "interval_join", "late_side_output",
    "lateness_refire", "value_state_alert", "map_state_counts", "broadcast_threshold", "changelog", "weighted_avg",
    "lateral_split_left",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = session("bench", f"local[{cpus}]", partitions=cpus, **{"spark.driver.memory": "6g"})
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in HEADLINE:
        runs = []
        for _ in range(4):  # the first warms up
            began = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - began)
        times[name] = round(statistics.median(runs[1:]), 3)
    print(json.dumps({"metric": "total of median seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": folder.rstrip("/").rpartition("sf")[2]}))
    spark.stop()


if __name__ == "__main__":
    main()
