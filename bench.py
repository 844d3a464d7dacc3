"""Bench: headline jobs over whole tables, written to a no-op sink.

Prints one JSON line; rates count the rows a job scores. BENCH_SF_DIR names the tables, BENCH_CPUS the cores.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from checks import inputs  # noqa: E402
from checks.registry import CHECKS  # noqa: E402
from checks.session import local_session  # noqa: E402


def rows_of(name):
    return lambda spark, sf: inputs.table(spark, sf, name)


#: Query of every job, and the rows that it scores.
HEADLINES = {
    "url_verdicts": ("u14_url_score", inputs.urls),
    "navigation_stream": ("w01_stream_equals_batch", inputs.nav),
    "page_features": ("s05_page_features", rows_of("pages")),
    "page_verdicts": ("c09_page_verdict", rows_of("pages")),
    "combined_verdicts": ("b04_combined_verdict", rows_of("pages")),
    "term_scores": ("c03_category_score", rows_of("documents")),
    "term_dictionary": ("c02_term_dictionary_join", rows_of("documents")),
    "message_verdicts": ("m13_message_score", inputs.messages),
    "sender_words": ("r06_looks_random", rows_of("documents")),
    "lookalike_join": ("u06_fuzzy_lookalike_join", inputs.urls),
    "asof_enrichment": ("e01_asof_ttl", inputs.nav),
    "mail_debounce": ("w03_mail_scans", rows_of("events")),
}


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    # warm up the JVM and Python workers on another query, untimed
    for query in ("u01_host_extraction", "s07_open_mail"):
        CHECKS[query][0](spark, sf).write.format("noop").mode("overwrite").save()
    took, rates = {}, {}
    for name, (query, scored) in HEADLINES.items():
        rows = scored(spark, sf).count()
        start = time.perf_counter()
        CHECKS[query][0](spark, sf).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - start, 3)
        rates[name] = round(rows / took[name])
    print(json.dumps({
        "metric": "headline jobs, total", "value": round(sum(took.values()), 3), "unit": "sec",
        "queries": took, "rows_per_sec": rates, "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf"),
        "cores": spark.sparkContext.defaultParallelism,
        "driver_memory": spark.conf.get("spark.driver.memory", "default"),
    }))


if __name__ == "__main__":
    main()
