"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the tables, BENCH_CPUS the local threads; BENCH_QUERIES may list other query
names (comma separated) or be ``all``. Each query is planned and run once into a sink that keeps
nothing, after one small warm-up query.
"""

from __future__ import annotations

import json
import os
import sys
import time

from cobaltmill.catalog import QUERIES
from cobaltmill.session import get_session, release

HEADLINE = (
    "analysis_spec", "chart_ranking", "group_count", "group_sum", "group_mean", "column_roles",
    "auto_chart", "month_sort", "chart_pie", "chart_heatmap", "corr_matrix", "chart_stacked",
    "demand_summary", "chart_history", "norm_text", "strip_accents", "delimiter_sniff", "id_normalize",
    "parse_cop", "parse_usd", "typed_by_name", "harmonize_fuzzy", "date_coerce", "locf",
    "locf_by_file", "clean_table", "raw_scan", "mime_audit", "chunk_text", "chunk_fixed",
    "context_assemble", "cosine_topk", "cosine_topk_batch", "tenant_scope", "error_class",
    "daily_quota", "quota_state", "get_or_create", "identity_link", "entitlement_gate",
    "token_outcome", "webhook_normalize", "payment_fold", "payment_outcome",
    "signature_audit", "store_summary", "daily_quota_stream", "payment_fold_stream",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    chosen = os.environ.get("BENCH_QUERIES", "")
    names = list(QUERIES) if chosen == "all" else chosen.split(",") if chosen else list(HEADLINE)
    spark = get_session(
        "bench", f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g",
           "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["group_max"](spark, sf_dir).collect()
    times = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        release(spark)
    spark.stop()
    print(json.dumps({
        "metric": "total_query_time", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))
    sys.stdout.flush()


if __name__ == "__main__":
    main()
