"""Time the headline queries and print one JSON line.

Each query writes its whole result to a sink that drops it, so nothing is pruned
away.  The stage tables the read side works on are built once, before the
queries that read them; ``enriched_posts`` builds its own and is timed in full.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from custvoice.queries import queries, stages  # noqa: E402
from custvoice.session import build_session  # noqa: E402

RUNS = 3


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    chosen = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q]
    spark = build_session(
        "custvoice-bench", f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false",
           "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "16g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    stages(spark, sf_dir)
    times = {}
    for name, query in queries().items():
        if chosen and name not in chosen:
            continue
        runs = []
        for _ in range(RUNS):
            start = time.perf_counter()
            query(spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        times[name] = round(min(runs), 3)
    spark.stop()
    print(json.dumps({
        "metric": "total of the fastest run per query", "value": round(sum(times.values()), 3),
        "unit": "sec", "queries": times, "sf": Path(sf_dir).name.removeprefix("sf"),
        "cpus": int(cpus), "runs": RUNS,
    }))


if __name__ == "__main__":
    main()
