"""Time the headline queries and print one JSON line.

BENCH_SF_DIR  folder of the tables (default /root/testdata/sf0.1)
BENCH_CPUS    local threads (default 8)
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import SparkSession

from marginalia.queries import all_queries
from marginalia.queries.inputs import forget_saved
from marginalia.session import clear_scratch

HEADLINE = (
    "c1_summary",
    "g14_gate_report",
    "d1_dedup_first",
    "d2_sample_k",
    "d3_compact_code",
    "d4_stratified",
    "d6_shuffle_pos",
    "d10_mix_50_50",
    "code_corpus_counts",
    "commit_corpus_counts",
    "a5_matrix",
    "r3_final_mixed",
    "t0_vocab",
    "t1_tokenize",
    "t5_padded_batches",
    "t7_profile",
    "e4_language",
    "l1_curves",
    "l7_sweep",
    "s4_write_by_language",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries, times = all_queries(), {}
    queries["a1_top"](spark, sf_dir).collect()  # starts the JVM threads and loads the classes; not timed
    for name in sys.argv[1:] or HEADLINE:
        forget_saved()  # every query does all of its work
        clear_scratch(spark)
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "headline queries, total", "value": total, "unit": "sec", "queries": times, "sf": sf_dir}))
    spark.stop()


if __name__ == "__main__":
    main()
