"""Summarise the physical plan of every registered query (initial adaptive plan)
into a markdown table: scans and columns read, pushed filters, shuffles,
broadcasts, map-side window limits.

usage: python tools/plan_summary.py [sf_dir] > PLANS.md
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def _nodes(plan):
    """All nodes of a physical plan (JVM objects), pre-order."""
    out, stack = [], [plan]
    while stack:
        n = stack.pop()
        out.append(n)
        kids = n.children()
        stack.extend(kids.apply(i) for i in range(kids.size() - 1, -1, -1))
    return out


def summarise(df) -> dict:
    ep = df._jdf.queryExecution().executedPlan()
    plan = ep.initialPlan() if ep.nodeName() == "AdaptiveSparkPlan" else ep
    nodes = _nodes(plan)
    names = [n.nodeName() for n in nodes]
    scans, pushed, ckpt = [], False, False
    for n in nodes:
        cls = n.getClass().getSimpleName()
        if cls == "FileSourceScanExec":
            table = n.relation().location().rootPaths().head().getName().split(".")[0]
            fmt = n.relation().fileFormat().toString().split("@")[0].lower()
            fmt = "json" if "json" in fmt else "parquet" if "parquet" in fmt else fmt
            scans.append(f"{table if fmt == 'parquet' else fmt}:{n.requiredSchema().size()}")
            pushed = pushed or n.dataFilters().size() > 0
        elif cls in ("RDDScanExec", "ExistingRDDScanExec") or "ExistingRDD" in n.nodeName():
            ckpt = True
    text = plan.toString()
    return {
        "scans": ", ".join(scans) or "-",
        "pushed": "yes" if pushed else "-",
        "exchanges": sum(1 for x in names if x == "Exchange"),
        "broadcast": sum(1 for x in names if x == "BroadcastExchange"),
        "wgl": "yes" if "WindowGroupLimit" in names else "-",
        "expand": "yes" if "Expand" in names else "-",
        "checkpoint": "yes" if ckpt or "Scan ExistingRDD" in text else "-",
    }


def main():
    from runlens.plans.bindings import QUERIES
    from runlens import get_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = get_session("local[8]")
    print("# Physical plan summary\n")
    print(f"Initial adaptive plans of every query of the reference's operators on `{sf}` (AQE may still turn a "
          "shuffle join into a broadcast, or coalesce partitions, at run time). Scans list "
          "table:columns read (json = a JSON scan of a written stand-in); `checkpoint` = reads a checkpointed intermediate "
          "(ranked reports, exact-quantile snapshots).\n")
    print("| query | scans (table:columns read) | pushed filters | shuffles | broadcasts | "
          "map-side window limit | expand | checkpoint |")
    print("|---|---|---|---|---|---|---|---|")
    for name, fn in QUERIES.items():
        s = summarise(fn(spark, sf))
        print(f"| {name} | {s['scans']} | {s['pushed']} | {s['exchanges']} | {s['broadcast']} | "
              f"{s['wgl']} | {s['expand']} | {s['checkpoint']} |")


if __name__ == "__main__":
    main()
