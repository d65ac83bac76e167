"""Print a markdown table: query, median seconds (from a bench JSON), input
rows of the tables it reads, and the operator counts of its physical plan.

    python scripts/plan_report.py bench.json [sf_dir]
"""

from __future__ import annotations

import json
import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from petrograph.plans.inspect import op_counts  # noqa: E402
from petrograph.plans.registry import load_all  # noqa: E402
from petrograph.session import build_session  # noqa: E402

EAGER = {"snapshot_write", "forecast_train_score", "forecast_explanation", "throttle_events",
         "node_ordinals", "stream_live_feed", "stream_alerts", "stream_event_windows", "stream_price_change"}


def main() -> None:
    bench = json.load(open(sys.argv[1]))
    sf_dir = sys.argv[2] if len(sys.argv) > 2 else "/root/testdata/sf0.1"
    spark = build_session("local[8]", shuffle_partitions=16)
    reg = load_all()
    print("| query | ref | median s | shuffles | broadcasts | BHJ | SMJ | windows | hash agg | sort agg |")
    print("|---|---|---|---|---|---|---|---|---|---|")
    for name, secs in sorted(bench["queries"].items()):
        if name in EAGER:
            c = {}
            note = " (eager: stream/model/checkpoint)"
        else:
            c = op_counts(reg[name].build(spark, sf_dir))
            note = ""
        print(f"| {name}{note} | {reg[name].ref} | {secs:.2f} | {c.get('Exchange', '-' if note else 0)} | "
              f"{c.get('BroadcastExchange', '-' if note else 0)} | {c.get('BroadcastHashJoin', '-' if note else 0)} | "
              f"{c.get('SortMergeJoin', '-' if note else 0)} | {c.get('Window', '-' if note else 0)} | "
              f"{c.get('HashAggregate', '-' if note else 0)} | {c.get('SortAggregate', '-' if note else 0)} |")


if __name__ == "__main__":
    main()
