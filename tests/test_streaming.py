"""Streaming ingestion: new files only, exactly once across restarts."""

import json

from runlens.operators.stats import run_tally
from runlens.streaming.ingest import ingest_runs, stream_runs


def _rows(provider, n, ok=True):
    return [{"created_at": "2026-03-06T00:00:00.000Z", "provider": provider, "session_creation_ms": i,
             "session_connect_ms": 1, "page_goto_ms": 1, "session_release_ms": 1, "success": ok}
            for i in range(n)]


def _write(d, name, rows):
    with open(d / name, "w") as f:
        f.write("\n".join(json.dumps(r) for r in rows) + "\n")


def test_ingest_resumes_without_duplicates(spark, tmp_path):
    src = tmp_path / "results"
    src.mkdir()
    _write(src, "kernel.jsonl", _rows("KERNEL", 3))
    _write(src, "idle-kernel.jsonl", [{"created_at": "t", "provider": "KERNEL", "success": True}])
    out, ckpt = str(tmp_path / "pq"), str(tmp_path / "ckpt")

    q = ingest_runs(stream_runs(spark, str(src), "lifecycle"), out, ckpt)
    q.awaitTermination(120)
    assert spark.read.parquet(out).count() == 3

    _write(src, "steel.jsonl", _rows("STEEL", 2, ok=False))
    q = ingest_runs(stream_runs(spark, str(src), "lifecycle"), out, ckpt)
    q.awaitTermination(120)
    df = spark.read.parquet(out)
    assert df.count() == 5
    t = {r["provider"]: (r["n_success"], r["n_failure"]) for r in run_tally(df).collect()}
    assert t == {"KERNEL": (3, 0), "STEEL": (0, 2)}
    assert {r[0] for r in df.select("kind").distinct().collect()} == {"lifecycle"}
