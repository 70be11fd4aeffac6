"""Time the headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "source_counts_total",
    "recent_by_category",
    "recent_updates",
    "lookup_by_identifier",
    "missing_fields",
    "duplicate_urls",
    "text_lengths",
    "all_checks",
    "validate_split",
    "title_normalised",
    "exact_duplicates",
    "fuzzy_duplicates",
    "similar_urls",
    "entity_tags",
    "top_trends",
    "topic_edges",
    "daily_summary",
    "labelled_values",
    "events_built",
    "source_freshness",
    "event_quality_summary",
    "review_items",
    "postings_stats",
    "search_all_terms",
    "search_phrase",
    "search_ranked",
    "query_log_parse",
    "upsert_latest",
    "feed_rss",
    "sql_read_only",
]


def main() -> None:
    from gazette.registry import QUERIES
    from gazette.session import local_session

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    names = os.environ.get("BENCH_QUERIES", "").split() or HEADLINE
    spark = local_session(cores, int(cores) if cores.isdigit() else 8)
    # Start the engine before the first measurement.
    QUERIES["source_counts_total"](spark, folder).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        start = time.time()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
    total = round(sum(seconds.values()), 3)
    spark.stop()
    print(json.dumps({"metric": "headline_queries", "value": total, "unit": "sec", "queries": seconds, "sf": folder.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
