"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import sys
import time
from pathlib import Path

ROOT = str(Path(__file__).resolve().parent)
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, os.environ.get("PYTHONPATH", "")) if x)

from graphloom import catalog  # noqa: E402
from graphloom.session import local_session  # noqa: E402

HEADLINE = [
    "risk_ranking", "churn_windows", "co_change_edges", "surprising_links", "omissions", "file_importance", "rrf_fusion", "graph_nodes", "graph_subgraph_d2", "pagerank_k10",
    "scc_members", "blast_radius_level", "module_coupling", "god_files", "top_terms", "term_frequency_signal", "regex_search_context", "secret_scan", "embedding_topk",
    "context_diff", "naming_style", "debounce_sessions",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores, 8, "bench")
    spark.sparkContext.setLogLevel("ERROR")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    catalog.QUERIES["language_stats"](spark, sf).collect()  # warm
    took = {}
    for n in names:
        began = time.time()
        catalog.QUERIES[n](spark, sf).write.format("noop").mode("overwrite").save()
        took[n] = round(time.time() - began, 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
