"""Run the headline queries and print one JSON line with their wall-clock seconds."""

from __future__ import annotations

import json
import os
import sys
import time

from baitline.plans.catalog import QUERIES
from baitline.session import build_session

HEADLINE = [
    "normalize_urls", "validate_urls", "url_features", "rule_score", "fuse_risk", "explain_risk", "risk_by_domain",
    "threat_report_from_verdicts", "enrich_threat_intel", "flag_trusted_by_table", "history_rows", "scan_stats",
    "recent_scans", "rate_limit", "ttl_cache_events", "cache_lookup", "job_latest", "job_expiry",
    "dedup_urls", "staged_union", "mutate_urls", "stratified_split", "group_split", "cross_split_overlap",
    "feature_profile", "domain_concentration", "roc_auc", "average_precision", "ngram_document_frequency",
    "train_logreg", "train_forest", "train_boosted", "train_hostname_model", "score_urls",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]", **{
            "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g", "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{folder}/pages.parquet").count()
    names = sys.argv[1:] or HEADLINE
    timings: dict[str, float] = {}
    for name in names:
        started = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        timings[name] = round(time.perf_counter() - started, 3)
    spark.stop()
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(timings.values()), 3), "unit": "sec",
        "queries": timings, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
