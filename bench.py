"""Time the headline queries on the reshaped test tables and print one JSON line.

The reshaped tables are written as Parquet first (not timed), as an installation would hold them. Each query
runs once to warm up and then BENCH_RUNS times; its result goes to a noop sink. Reported: the median.
"""

from __future__ import annotations

import json
import os
import statistics
import tempfile
import time

from leverwise.plans.registered import all_queries
from leverwise.session import build_session
from leverwise.sources.sample import SAMPLE, SampleTables, needs

HEADLINES = [
    "resolved_values", "calc_inputs", "values_for_attributes", "compare_datasets", "screen_data", "category_columns",
    "descendants", "sensitivity_impacts", "attribution_impacts", "apply_changes", "copy_dataset", "merge_calculated",
    "mark_redundant", "import_sensitivity", "import_model", "dataset_catalogue", "reconcile_access_groups",
]


def stored_tables(spark, sf_dir: str, root: str) -> SampleTables:
    """Sample tables written once and read back, facts sorted by their key."""
    made = SampleTables(spark, sf_dir)
    frames = {}
    for name in SAMPLE:
        path = f"{root}/{name}"
        getattr(made, name).write.parquet(path)
        frames[name] = spark.read.parquet(path)
    assert all(other in SAMPLE or hasattr(made, other) for sql in SAMPLE.values() for other in needs(sql))
    return made.replace(**frames)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "5"))
    chosen = os.environ.get("BENCH_QUERIES", "")
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "16g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    tables = stored_tables(spark, sf_dir, tempfile.mkdtemp(prefix="bench-"))
    known = all_queries()
    seconds = {}
    for name in chosen.split(",") if chosen else HEADLINES:
        build, _ = known[name]
        times = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            build(tables).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(times[1:]), 3)
    total = round(sum(seconds.values()), 3)
    print(
        json.dumps(
            {"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": seconds,
             "sf": os.path.basename(sf_dir.rstrip("/"))}
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
