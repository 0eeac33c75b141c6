"""Headline queries at one scale factor; prints one JSON line.

Each query is built and drained once to warm the session on the smallest data,
then timed on ``$BENCH_SF_DIR``: plan building, staged tables and all rows.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from catalogue.queries import QUERIES  # noqa: E402
from taxaledger.session import local_session  # noqa: E402

HEADLINE = (
    "normalize_names", "exact_match", "fuzzy_match", "resolve_names", "threat_status",
    "occurrences_in_buffer", "occurrence_counts", "area_regions", "distribution_flags", "standardized",
)


def drain(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session("bench", cores=cpus, partitions=32)
    warm = os.path.join(os.path.dirname(folder.rstrip("/")), "sf0.001")
    if os.path.isdir(warm):
        drain(QUERIES["standardized"](spark, warm))
    seconds = {}
    for name in HEADLINE:
        start = time.time()
        drain(QUERIES[name](spark, folder))
        seconds[name] = round(time.time() - start, 2)
        print(f"{name}: {seconds[name]} s", file=sys.stderr)
    scale = re.search(r"sf([0-9.]+)", folder)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 2), "unit": "sec",
        "queries": seconds, "sf": float(scale.group(1)) if scale else None,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
