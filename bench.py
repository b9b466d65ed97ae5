"""All registered queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line."""

import json
import os
import time

from exposurelab.plans.queries import REGISTRY, Tables
from exposurelab.session import local_session

QUERIES = list(REGISTRY)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, partitions=int(cpus) if cpus.isdigit() else 8)
    tables = Tables(spark, folder)
    # One untimed run pays for the start of the JVM.
    REGISTRY["backdoor_ate"][0](tables).collect()
    times = {}
    for name in os.environ.get("BENCH_QUERIES", ",".join(QUERIES)).split(","):
        start = time.perf_counter()
        REGISTRY[name][0](tables).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": folder.rstrip("/").rsplit("sf", 1)[-1],
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
