"""Headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from foliary.checks import QUERIES
from foliary.session import build_session

HEADLINE = (
    "run_extraction_summary", "pipe_01_classify_from_roots", "pipe_02_classify_then_extract", "pipe_03_single_pass",
    "pipe_04_multi_pass", "pipe_05_table_enrichment", "pipe_06_entities", "pipe_06_flat_records", "jn_01_cache_hits",
    "jn_02_cache_misses", "jn_06_reference_by_name", "jn_08_delete_keeps", "agg_03_part_merge", "agg_04_entity_merge",
    "agg_06_entity_usage", "fn_06_strict_validation", "fn_12_written_dates", "fn_16_entity_tagging", "fn_21_markdown_records",
    "src_07_content_memo", "win_01_unique_names", "win_03_dense_ids", "snk_07_index_lines",
    "udf_01_provider_hook", "udf_01_part_filled_cache",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    chosen = sys.argv[1:] or HEADLINE
    spark = build_session(
        "bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__driver__memory="16g",
        spark__ui__enabled="false", spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{folder}/documents.parquet").groupBy("lang").count().write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in chosen:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(json.dumps({
        "metric": "total seconds of the headline queries", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(folder.rstrip("/")),
    }))


if __name__ == "__main__":
    main()
