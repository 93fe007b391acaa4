"""Summarise a Spark event log: per job group (bench query), jobs, stages,
tasks, summed task time and the slowest stage.

usage: python tools/stage_times.py EVENT_LOG (file or v2 event-log folder)
(bench.py writes one when BENCH_EVENT_LOG_DIR names a scratch folder)
"""

from __future__ import annotations

import json
import sys
from collections import defaultdict


def _lines(path: str):
    """Event-log lines from a file or a v2 event-log folder (events_*, maybe zstd)."""
    import io
    import os
    files = ([os.path.join(path, f) for f in sorted(os.listdir(path)) if f.startswith("events_")]
             if os.path.isdir(path) else [path])
    for p in files:
        if p.endswith(".zstd"):
            import zstandard
            with open(p, "rb") as fh:
                text = io.TextIOWrapper(zstandard.ZstdDecompressor().stream_reader(fh), encoding="utf-8")
                yield from text
        else:
            with open(p) as fh:
                yield from fh


def main(path: str) -> None:
    group_of_job, stage_job, stage_wall = {}, {}, {}
    task_ms, tasks = defaultdict(int), defaultdict(int)
    for line in _lines(path):
        e = json.loads(line)
        ev = e.get("Event")
        if ev == "SparkListenerJobStart":
            group_of_job[e["Job ID"]] = (e.get("Properties") or {}).get("spark.jobGroup.id", "-")
            for sid in e.get("Stage IDs", []):
                stage_job[sid] = e["Job ID"]
        elif ev == "SparkListenerTaskEnd":
            info = e.get("Task Info", {})
            task_ms[e.get("Stage ID")] += info.get("Finish Time", 0) - info.get("Launch Time", 0)
            tasks[e.get("Stage ID")] += 1
        elif ev == "SparkListenerStageCompleted":
            si = e["Stage Info"]
            stage_wall[si["Stage ID"]] = si.get("Completion Time", 0) - si.get("Submission Time", 0)
    rows = defaultdict(lambda: {"jobs": set(), "stages": 0, "tasks": 0, "task_ms": 0, "wall_ms": 0,
                                "slow": (0, 0)})
    for sid, wall in stage_wall.items():
        r = rows[group_of_job.get(stage_job.get(sid), "-")]
        r["jobs"].add(stage_job.get(sid))
        r["stages"] += 1
        r["tasks"] += tasks[sid]
        r["task_ms"] += task_ms[sid]
        r["wall_ms"] += wall
        if wall > r["slow"][0]:
            r["slow"] = (wall, tasks[sid])
    print(f"{'group':24s} {'jobs':>4s} {'stages':>6s} {'tasks':>6s} {'stage_s':>7s} {'task_s':>7s}  "
          "slowest stage (s, tasks)")
    for g, r in sorted(rows.items(), key=lambda kv: -kv[1]["wall_ms"]):
        print(f"{g:24s} {len(r['jobs']):4d} {r['stages']:6d} {r['tasks']:6d} {r['wall_ms'] / 1000:7.2f} "
              f"{r['task_ms'] / 1000:7.2f}  {r['slow'][0] / 1000:.2f} ({r['slow'][1]})")


if __name__ == "__main__":
    main(sys.argv[1])
