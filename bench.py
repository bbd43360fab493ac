"""Headline timings at one scale; prints ONE JSON line.

Env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
Each query is run to completion with a no-op sink (``write.format('noop')``),
so the whole plan executes without collecting rows to the driver.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from domsift.plans.queries import QUERIES  # noqa: E402
from domsift.session import local_session  # noqa: E402

HEADLINE = [
    "rule_tags",
    "match_rules_table",
    "asn_join",
    "asn_enrich_nested",
    "range_normalise",
    "registrable_domain",
    "suppress_repeats",
    "dns_status_counts",
    "retry_outcome",
    "digest_text",
    "pipeline_end_to_end",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, int(cpus) if cpus.isdigit() else 8, app="domsift-bench")
    # warm-up: JVM, Python workers, codegen caches
    QUERIES["rule_tags"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for name in HEADLINE:
        t0 = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
    total = round(sum(times.values()), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": times, "sf": sf}))


if __name__ == "__main__":
    main()
