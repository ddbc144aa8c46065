"""Times the headline queries and prints one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py [name ...]

Each query runs to completion into Spark's no-op sink, twice; the better time counts, so that
class loading and code generation of the first run do not.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from goldseam.queries import load_all
from goldseam.session import build_session

HEADLINE = (
    "cast_reasons_int64", "cast_reasons_float64", "cast_reasons_bool", "cast_decision",
    "cast_decision_by_dataset", "cast_diagnostics", "cast_materialize_check",
    "observe_schema", "observe_nulls", "key_proof", "json_unique_count", "infer_logical_type",
    "schema_delta", "complete_match", "reorder_eligibility",
    "propose_repairs", "select_plan", "parse_actions", "safety_gates",
    "dataset_fingerprint", "dataset_fingerprint_merkle", "gold_fingerprint", "decode_payloads",
    "preservation_proof", "repair_cast", "trusted_read_summary", "snapshot_dedupe",
    "snapshot_replay_check", "publish_version", "register_versions", "run_violations",
    "ticket_states", "latest_marker", "reconcile", "execution_transitions", "simulate_migration",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "goldseam-bench",
        master=f"local[{cpus}]",
        **{
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "12g",
            "spark.sql.shuffle.partitions": cpus,
            "spark.sql.files.maxPartitionBytes": str(4 * 1024 * 1024),
            "spark.checkpoint.dir": tempfile.mkdtemp(prefix="goldseam-bench-"),
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    registered = load_all()
    names = sys.argv[1:] or HEADLINE
    times: dict[str, float] = {}
    for name in names:
        best = None
        for _ in range(2):
            start = time.perf_counter()
            registered[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - start
            best = took if best is None else min(best, took)
        times[name] = round(best, 3)
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
