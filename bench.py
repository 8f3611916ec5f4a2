"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from docloom import checks  # noqa: E402

HEADLINE = [
    "pg1_page_quality", "pg5_strip_repeating_lines", "sec4_detect_sections", "ch2_consolidate_sections", "ch6_split_with_overlap",
    "rt7_bm25", "rt1_dense_topk", "rt11_keyword_select", "rt14_select_chunks", "gr5_resolve_pages", "gr10_quote_in_document",
    "fd1_parse_date", "fd7_build_spec_rows", "fd21_dedupe_rows", "fb9_recheck", "an1_user_insights", "an9_field_matrix",
    "cor2_exact_duplicates", "ev9_retrieval_metrics", "st1_stage_durations",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    scratch = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("docloom-bench")
        .config("spark.sql.shuffle.partitions", str(max(int(cpus), 8))).config("spark.driver.memory", "16g")
        .config("spark.sql.adaptive.enabled", "true").config("spark.ui.enabled", "false").config("spark.local.dir", scratch)
        .config("spark.sql.session.timeZone", "UTC").config("spark.sql.files.maxPartitionBytes", "4m")
        .config("docloom.input.partitions", cpus).config("spark.checkpoint.dir", f"{scratch}/stages").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    only = sys.argv[1:] or HEADLINE
    times: dict[str, float] = {}
    for name in only:
        begin = time.time()
        checks.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - begin, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf}), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
