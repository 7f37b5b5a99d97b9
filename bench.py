"""Times the headline queries; prints one JSON line.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the cores, ``BENCH_QUERIES`` a choice of queries. Every query runs
once to warm up, then all run ``BENCH_RUNS`` times; the best time counts. Queries on the ledger read a stored one;
making it from the requests is timed as ``seal_ledger``.
"""

from __future__ import annotations

import json
import os
import time

from wardline.catalog.queries import QUERIES
from wardline.session import build_session

HEADLINE = [
    "decide",
    "mask_pii_documents",
    "mask_pii_pages",
    "detect_pii_documents",
    "fairness_flag_documents",
    "safety_score",
    "verify_output",
    "gateway_response",
    "gateway_ledger",
    "seal_ledger",
    "ledger_append",
    "verify_chain",
    "chain_links",
    "apply_reviews",
    "duplicate_requests",
    "health_report_by_tenant",
    "ledger_counts",
    "hash_uniqueness",
    "ledger_recent",
    "review_queue",
    "load_report",
    "red_team_battery",
    "kill_switch_gate",
    "cosine_topk",
    "ann_topk",
    "question_passages",
    "stream_decide",
    "stream_seal",
]
# Rows that a query decides on, masks, seals or checks, for rows per second.
ROWS_OF = {
    "decide": "events",
    "mask_pii_documents": "documents",
    "verify_output": "events",
    "seal_ledger": "events",
    "verify_chain": "events",
}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    names = os.environ["BENCH_QUERIES"].split(",") if "BENCH_QUERIES" in os.environ else HEADLINE
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": os.environ.get("BENCH_SHUFFLE_PARTITIONS", cpus),
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "16g"),
            "spark.ui.enabled": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}
    for attempt in range(runs + 1):
        for name in names:
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            elapsed = time.perf_counter() - start
            if attempt:
                times[name] = min(elapsed, times.get(name, elapsed))
    rates = {
        name: round(spark.read.parquet(f"{sf_dir}/{table}.parquet").count() / times[name])
        for name, table in ROWS_OF.items()
        if name in times
    }
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": {name: round(t, 3) for name, t in times.items()},
                "rows_per_sec": rates,
                "sf": os.path.basename(sf_dir.rstrip("/")),
                "cpus": int(cpus),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
