"""Times the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

import quayside.plans.catalog  # noqa: F401
from quayside.plans.registry import QUERIES
from quayside.session import build_session

# One or two of each family: comparison, query log, blocking, dumps, inference,
# fleet checks, streams.
HEADLINE = [
    "j2_table_diff",
    "j2_diff_repeated_keys",
    "c6_verify",
    "f11_typed_row_diff",
    "a5_query_rollup",
    "u3_overview",
    "w5_violation_periods",
    "g5_hourly_rollup",
    "a7_blocking_counts",
    "j6_upstream_chain",
    "i8_locks",
    "k1_sql_dump",
    "k2_csv_dump",
    "k3_json_dump",
    "k6_restore_sql",
    "y1_infer_types",
    "y5_typed_load",
    "f25_statement_class",
    "i4_redundant_indexes",
    "i11_bloat",
    "c3_lookup",
    "s5_read_snapshots",
    "k5_trace_roundtrip",
    "g5_hourly_stream",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "16g",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    # The first query would otherwise pay for the start of the JVM.
    QUERIES["a1_row_counts"](spark, sf_dir).collect()
    spent = {}
    for name in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(","):
        started = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        spent[name] = round(time.perf_counter() - started, 3)
    print(
        json.dumps(
            {
                "metric": "headline queries, total wall time",
                "value": round(sum(spent.values()), 3),
                "unit": "sec",
                "queries": spent,
                "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
                "cpus": int(cpus),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
