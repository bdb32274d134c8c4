"""Seconds per headline query: median of the timed runs after one warm-up, nothing kept between runs.

Environment: BENCH_SF_DIR (tables), BENCH_CPUS (cores), BENCH_RUNS (timed runs), BENCH_QUERIES (comma list).
Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pagelore.plans import catalog, shared  # noqa: E402
from pagelore.session import build_session  # noqa: E402

HEADLINE = ["chunk_documents", "vector_topk", "bm25_scores", "hybrid_search", "rag_query", "top_words", "doc_relationships",
            "bleu2", "analytics_overview", "session_history", "tables_from_text", "faq_table", "compare_word_counts", "cache_hits_ttl"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    names = os.environ.get("BENCH_QUERIES", "").split(",") if os.environ.get("BENCH_QUERIES") else HEADLINE
    spark = build_session("bench", f"local[{cpus}]", max(cpus, 8))
    queries, seconds = catalog.queries(), {}
    for name in names:
        times = []
        for run in range(runs + 1):
            shared.release()
            start = time.perf_counter()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - start
            if run or runs == 0:
                times.append(took)
            print(f"{name} run {run}: {took:.2f}s", file=sys.stderr, flush=True)
        seconds[name] = round(statistics.median(times), 3)
    shared.release()
    print(json.dumps({"metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
                      "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1], "cpus": cpus, "runs": runs}))


if __name__ == "__main__":
    main()
