"""Headline queries at one scale; prints one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_QUERIES (comma-separated names, or "all").
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from lexloom import catalog  # noqa: E402
from lexloom.session import build_session  # noqa: E402

HEADLINE = [
    "daily_volume", "latency_percentiles", "satisfaction_by_topic", "matters_with_counts", "rate_limit_violations",
    "invite_status", "redact_pii", "sanitize_answers", "classify_documents", "extract_chunk_metadata", "chunk_law", "chunk_case",
    "extract_page_text", "parse_decisions", "detect_changes", "assign_versions", "score_relevance", "session_context",
    "knn_cosine", "knn_approx", "hybrid_search", "retrieve", "map_sections", "answer_contexts", "ingest_corpus",
    "stream_volume", "stream_rate_limit",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    chosen = os.environ.get("BENCH_QUERIES", "")
    names = list(catalog.QUERIES) if chosen == "all" else [q for q in chosen.split(",") if q] or HEADLINE
    spark = build_session("bench", f"local[{cpus}]", int(cpus))
    spark.sparkContext.setLogLevel("ERROR")
    run = lambda name: catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    run("daily_volume")  # start the executors and warm the file cache
    times: dict[str, float] = {}
    for name in names:
        start = time.perf_counter()
        run(name)
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    total = round(sum(times.values()), 3)
    print(json.dumps({
        "metric": "total_query_seconds", "value": total, "unit": "sec", "queries": times, "sf": sf_dir.rstrip("/").split("sf")[-1],
    }))


if __name__ == "__main__":
    main()
