"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import sys
import time

from docweave.plans import QUERIES
from docweave.session import build_session

HEADLINE = ["chunk_documents", "bm25_topk", "retrieval_eval", "dense_topk", "self_similarity", "rrf_fuse", "neighbor_expand", "corpus_profile",
            "redact_secrets", "lexical_duplicates", "derive_links", "usage_daily", "usage_ledger", "label_audit_orphan", "cascade_documents",
            "session_batches", "rate_limit", "error_rate_windows", "order_statistics", "stage_percentiles"]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "16g",
        "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["category_counts"](spark, folder).count()
    seconds, rows = {}, {}
    for name in sys.argv[1:] or HEADLINE:
        best = None
        for _ in range(int(os.environ.get("BENCH_REPEAT", "2"))):
            start = time.perf_counter()
            rows[name] = len(QUERIES[name](spark, folder).collect()) if name in SMALL else _drain(QUERIES[name](spark, folder))
            took = time.perf_counter() - start
            best = took if best is None else min(best, took)
        seconds[name] = round(best, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
                      "rows": rows, "sf": os.path.basename(folder.rstrip("/"))}))
    spark.stop()


SMALL = {"retrieval_eval", "stage_percentiles", "order_statistics", "corpus_profile"}


def _drain(df) -> int:
    """Every row and column is produced; only a counter comes back."""
    from pyspark.sql import Observation, functions as F

    seen = Observation("rows")
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.format("noop").mode("overwrite").save()
    return seen.get["n"]


if __name__ == "__main__":
    main()
