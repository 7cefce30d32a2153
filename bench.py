"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` is the table folder, ``BENCH_CPUS`` the number of local threads. Each query runs
twice into the noop sink; the second run counts, so that JVM warm-up is left out.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from wardline import queries as registry  # noqa: E402
from wardline.session import build_session  # noqa: E402

HEADLINE = {
    "quality_gate": "d5_quality_gate",
    "rule_tagging": "e8_tag_rules",
    "rule_tagging_contexts": "e8_tag_rules_contexts",
    "barrier_portfolio": "g6_barrier_portfolio",
    "portfolio_cards": "g7_portfolio_cards",
    "cross_site_overview": "h2_site_overview",
    "cross_site_comparison": "h3_site_comparison",
    "cross_site_rules": "h9_rules_cross_site",
    "cross_site_recurrence": "h11_cross_site_recurrence",
    "decision": "f7_decide",
    "recurrence": "h12_recurring",
    "location_patterns": "g11_location_patterns",
    "activity_view": "g17_activity_view",
    "top_pathways": "g19_top_pathways",
    "related_incidents": "k2_related",
    "ranking_metrics": "t8_ranking_metrics",
    "lexical_leakage": "l3_lexical_leakage",
    "template_phrases": "l2_template_phrases",
    "flagship": "flagship_recurring_patterns",
}


def spread(spark, folder: str, parts: int) -> str:
    """The tables in as many files as there are threads, as larger tables have them: one file of one row group is one task."""
    target = tempfile.mkdtemp(prefix="bench-")
    for name in sorted(os.listdir(folder)):
        spark.read.parquet(f"{folder}/{name}").repartition(parts).write.parquet(f"{target}/{name}")
    return target


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    picked = sys.argv[1:] or list(HEADLINE)
    registry.load()
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g", "spark.ui.enabled": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    folder, given = spread(spark, folder, int(cpus)), folder
    times = {}
    for name in picked:
        run = registry.QUERIES[HEADLINE.get(name, name)]
        for _ in range(2):
            start = time.perf_counter()
            run(spark, folder).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(given.rstrip("/")),
    }))


if __name__ == "__main__":
    main()
