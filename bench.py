"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

os.environ.setdefault("PYSPARK_PYTHON", sys.executable)
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from sentryframe.checks import load_catalogue  # noqa: E402

# Hunting, the environment, correlation and ingest.
HEADLINE = (
    "w01_episodes_3_in_48h", "w02_sliding_max_distinct_types", "a09_connection_patterns",
    "j01_first_use_after_grant", "d02_encoded_powershell", "d03_interpreter_egress",
    "d04_lsass_access", "d05_brute_force", "d06_foreign_host_logon", "d08_archive_staging",
    "d11_recovery_inhibition", "d12_security_tool_tampering", "d15_service_discovery_burst",
    "d16_denial_burst", "d23_run_hunt_counts", "a02_a04_destination_profiles",
    "a03_process_profiles", "a05_host_inventory", "a06_a07_identity_inventory",
    "a16_channel_availability", "a21_actor_statistics", "c05_c07_links",
    "s03_n13_cloudtrail_controls", "s06_n17_winlogbeat", "s07_n18_elastic",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        # Recording the Python call site of every expression doubles the planning time.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = load_catalogue().QUERIES
    queries[HEADLINE[0]](spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm the JVM
    times = {}
    for name in HEADLINE:
        started = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - started, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
