"""Prints one JSON line with the seconds of the headline queries at $BENCH_SF_DIR."""

from __future__ import annotations

import json
import os
import time

from glosswork.plans import QUERIES
from glosswork.session import session

NAMES = [
    "e04_retrieval_eval", "k01_vector_topk", "w01_rank_diversify", "f13_recall_mrr_ndcg",
    "g01_filtered_counts", "j02_left_agg", "k02_pagination", "j07_leakage_contains",
    "u06_merge_classify", "w14_inbatch_dedup", "x01_section_lines", "x02_chunks", "x03_tokens",
    "t05_wilson", "t08_mcnemar_counts", "t13_t14_paired_bootstrap", "w08_holm", "g16_long_stats",
    "g26_spearman", "j26_two_copy_parity", "s04_html_visible", "f08_chrf", "w05_budget_pack",
    "w15_transitions",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = session(f"local[{cpus}]", int(cpus))
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["g04_count"](spark, folder).collect()  # starts the JVM's code paths
    seconds = {}
    for name in NAMES:
        began = time.time()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": folder.rstrip("/").rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
