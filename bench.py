"""Time the headline queries: prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose the data and the cores.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "volume_by_contact top_contacts_by_year response_times conversation_starters activity_heatmap "
    "streaks_silences emoji_words listening_minutes top_artists_by_year discovery_rate seasonality "
    "skips_obsessions soundtrack spend_by_category income_vs_spend weekday_weekend delivery_share "
    "subscriptions life_timeline spend_vs_listening year_over_year chat_messages plays_from_json "
    "transactions_from_csv shell_events activity_from_html idempotent_append cluster_identities "
    "assign_messages name_pairs"
).split()


def main() -> None:
    from chronicle import build_session
    from chronicle.plans.catalog import QUERIES

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = build_session(cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8)
    # Start the JVM's code paths before anything is timed.
    QUERIES["activity_heatmap"].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
    QUERIES["income_vs_spend"].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        started = time.perf_counter()
        QUERIES[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - started, 3)
    spark.stop()
    result = {
        "metric": "headline queries, total wall time",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }
    print(json.dumps(result))


if __name__ == "__main__":
    main()
