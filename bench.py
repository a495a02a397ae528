"""Benchmark: headline crawl-analytics jobs at $BENCH_SF_DIR on local[$BENCH_CPUS].

Prints one JSON line: {"metric", "value" (total seconds), "unit", "queries",
"sf", "pages", "pages_per_sec"}.  Each query is forced with a no-op write so
the whole plan runs without collecting rows to the driver.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from crawlscope.plans import catalog  # noqa: E402
from crawlscope.session import get_spark  # noqa: E402

HEADLINE = [
    "ld_page_status",        # captures -> classify -> redirects -> extract -> page status
    "ld_entities",           # captures -> blocks -> strict parse -> flattened entities
    "ex_csv_rows",           # export rows (CSV)
    "ex_markdown_sections",  # export sections (Markdown)
    "rob_verdicts",          # robots parse + prefix verdicts
    "sm_discovered_urls",    # sitemap parse + BFS discovery
    "url_dedup_cap",         # URL policy, dedup, top-k cap
    "au_export_roundtrip",   # write 3 formats, read back, audit
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_spark(f"local[{cpus}]", int(cpus))
    m = re.search(r"sf([0-9.]+)", sf_dir)
    sf = float(m.group(1)) if m else None
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").count()
    times = {}
    for name in HEADLINE:
        t0 = time.time()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": times, "sf": sf,
                      "pages": pages,
                      "pages_per_sec": round(pages / times["ld_page_status"], 2) if times["ld_page_status"] else None}))


if __name__ == "__main__":
    main()
