"""Scans and sinks on own NDJSON fixtures (SRC1-6, SNK1-3; hazards H1, H6, H10)."""

import os

import pytest
from pyspark.sql import functions as F

from runlens.operators.dims import canonical_provider
from runlens.operators.stats import run_tally, stage_totals
from runlens.sources.runlogs import parse_created_at, scan_runs, split_quarantine
from runlens.sources.schemas import LIFECYCLE, PARALLEL
from runlens.sources.sinks import (append_runs, convert_runs, read_converted, replace_slice, to_json_text,
                                   write_report)


def life(provider, ms, ok=True, release=None, ts="2026-03-01T00:00:00.000Z"):
    return {"created_at": ts, "id": None, "session_creation_ms": ms, "session_connect_ms": ms,
            "page_goto_ms": ms, "session_release_ms": ms if release is None else release,
            "provider": provider, "success": ok, "error_stage": None, "error_message": None}


def idle_row(provider, release):
    return {"created_at": "2026-03-01T00:00:00.000Z", "provider": provider, "step1_ms": 1,
            "idle_ms": 60000, "session_survived": True, "session_release_ms": release,
            "total_ms": 62800, "success": True}


def test_mixed_kind_glob_compat_vs_strict(spark, write_jsonl):
    # H1: a bare *.jsonl scan also reads idle rows; strict routing keeps lifecycle only
    d = write_jsonl({"kernel.jsonl": [life("KERNEL", 100), life("KERNEL", 100)],
                     "idle-kernel.jsonl": [idle_row("KERNEL", 900)],
                     "stealth.jsonl": [{"created_at": "x", "provider": "KERNEL", "mode": "default",
                                        "success": True}]})
    strict = stage_totals(scan_runs(spark, d, "lifecycle"), places=0).first()
    compat = stage_totals(scan_runs(spark, d, None, strict=False), places=0).first()
    assert strict["runs"] == 2 and strict["avg_release_ms"] == 100
    assert compat["runs"] == 4                     # foreign rows counted
    assert compat["avg_release_ms"] == 367         # (100+100+900)/3: idle release absorbed
    assert compat["avg_total_ms"] == 400           # NULL totals skipped
    kinds = {r["kind"]: r["n"] for r in scan_runs(spark, d, None, strict=False, with_file=True)
             .groupBy("kind").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert kinds == {"lifecycle": 2, "idle": 1, "stealth": 1}


def test_alias_files_double_count(spark, write_jsonl):
    # H6: bb.jsonl and browserbase.jsonl hold the same canonical provider
    d = write_jsonl({"bb.jsonl": [life("BROWSERBASE", 1)], "browserbase.jsonl": [life("BROWSERBASE", 2)]})
    t = run_tally(scan_runs(spark, d)).collect()
    assert [(r["provider"], r["n_success"]) for r in t] == [("BROWSERBASE", 2)]
    names = spark.createDataFrame([(" BB ",), ("browserbase",), ("anchor",), ("nope",), (None,)], "x string")
    assert [r[0] for r in names.select(canonical_provider("x")).collect()] == \
        ["BROWSERBASE", "BROWSERBASE", "ANCHORBROWSER", None, None]


def test_bad_lines_and_missing_inputs(spark, write_jsonl, tmp_path):
    # H10: malformed line; missing directory; empty file
    d = write_jsonl({"steel.jsonl": [life("STEEL", 1), "{not json", life("STEEL", 2)]})
    with pytest.raises(Exception):
        scan_runs(spark, d, bad_lines="failfast").collect()
    q = scan_runs(spark, d, bad_lines="quarantine")
    good, bad = split_quarantine(q)
    assert good.count() == 2 and [r["_corrupt_record"] for r in bad.collect()] == ["{not json"]
    assert bad.count() == 1 and "_corrupt_record" not in good.columns
    plan = good._jdf.queryExecution().executedPlan().toString()
    assert "ExistingRDD" not in plan  # no copy of the good rows
    missing = scan_runs(spark, str(tmp_path / "nope"))
    assert missing.count() == 0 and missing.schema == LIFECYCLE
    empty = write_jsonl({"kernel.jsonl": []}, sub="empty")
    assert scan_runs(spark, empty).count() == 0


def test_nested_batches_scan(spark, write_jsonl):
    b = {"created_at": "t", "provider": "STEEL", "run": 1, "concurrency": 3, "sequential_mode": False,
         "sessions": [{"session_index": 0, "session_total_ms": 10, "success": True},
                      {"session_index": 1, "session_total_ms": None, "success": False}],
         "sessions_succeeded": 1, "sessions_failed": 1, "total_parallel_ms": 7,
         "sequential_equivalent_ms": 10, "overhead_ratio": 0.7, "success": False}
    d = write_jsonl({"parallel-steel.jsonl": [b]})
    df = scan_runs(spark, d, "parallel")
    assert df.schema == PARALLEL
    r = df.select(F.size("sessions").alias("n"), F.col("sessions")[1]["session_total_ms"].alias("m")).first()
    assert (r["n"], r["m"]) == (2, None)


def test_created_at_parse(spark, write_jsonl):
    d = write_jsonl({"kernel.jsonl": [life("KERNEL", 1, ts="2026-03-06T12:34:56.789Z")]})
    r = parse_created_at(scan_runs(spark, d)).select(F.date_format("created_ts", "HH:mm:ss.SSS")).first()
    assert r[0] == "12:34:56.789"


def test_store_round_trips(spark, tmp_path):
    """append, replace and convert write one store that both readers read."""
    out = str(tmp_path / "runs")
    df1 = spark.createDataFrame([life("KERNEL", 1.5), life("STEEL", 2.0)], LIFECYCLE)
    append_runs(df1, out, "lifecycle")
    append_runs(df1, out, "lifecycle")
    back = scan_runs(spark, out)
    assert back.schema == LIFECYCLE
    assert sorted((r["provider"], r["session_creation_ms"], r["id"]) for r in back.collect()) == \
        [("KERNEL", 1.5, None)] * 2 + [("STEEL", 2.0, None)] * 2
    assert scan_runs(spark, out, "idle").count() == 0

    kernel = spark.createDataFrame([life("KERNEL", 9.0)], LIFECYCLE)
    replace_slice(kernel, out, [("lifecycle", "KERNEL")], "lifecycle")
    assert sorted((r["provider"], r["session_creation_ms"]) for r in scan_runs(spark, out).collect()) == \
        [("KERNEL", 9.0), ("STEEL", 2.0), ("STEEL", 2.0)]
    # a slice replaced by nothing is empty, and rows of other slices aren't written
    replace_slice(df1.where("provider = 'KERNEL'"), out, [("lifecycle", "STEEL")], "lifecycle")
    assert [r["provider"] for r in read_converted(spark, out, "lifecycle").collect()] == ["KERNEL"]
    replace_slice(df1, out, None, "lifecycle")
    assert sorted(r["session_creation_ms"] for r in scan_runs(spark, out).collect()) == [1.5, 2.0]


def test_convert_and_report_sink(spark, tmp_path, write_jsonl):
    d = write_jsonl({"kernel.jsonl": [life("KERNEL", 1)], "idle-kernel.jsonl": [idle_row("KERNEL", 5)]})
    pq = str(tmp_path / "pq")
    convert_runs(scan_runs(spark, d, None, strict=False, with_file=True), pq)
    df = spark.read.parquet(pq).where(F.col("kind") == "idle")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and df.count() == 1
    rep = str(tmp_path / "report")
    write_report(df.select("provider"), rep, "csv")
    assert spark.read.option("header", "true").csv(rep).count() == 1


def test_json_text_keeps_nulls(spark):
    df = spark.createDataFrame([(1, None)], "a int, b string")
    assert to_json_text(df).first()["json"] == '{"a":1,"b":null}'


def test_report_sink_files(spark, tmp_path):
    df = spark.range(0, 1000, numPartitions=4)
    asis, one = str(tmp_path / "asis"), str(tmp_path / "one")
    write_report(df, asis)
    write_report(df, one, files=1)
    parts = lambda p: [f for f in os.listdir(p) if f.endswith(".parquet")]
    assert len(parts(asis)) == 4 and len(parts(one)) == 1
    assert spark.read.parquet(asis).count() == spark.read.parquet(one).count() == 1000


def test_file_layout_does_not_change_results(spark, write_jsonl):
    from runlens.plans import reports
    rows = [life(p, 100 + i * 7 % 50, ok=i % 5 != 0, release=None if i % 9 == 0 else i,
                 ts=f"2026-03-0{1 + i % 9}T00:00:{i % 60:02d}.000Z")
            for i, p in enumerate(["KERNEL", "STEEL", "BROWSERBASE"] * 40)]
    one = write_jsonl({"all.jsonl": rows}, sub="one")
    many = write_jsonl({"c.jsonl": rows[:30][::-1], "b.jsonl": rows[30:80][::-1], "a.jsonl": rows[80:]},
                       sub="many")
    outs = []
    for d in (one, many):
        runs = scan_runs(spark, d)
        outs.append((sorted(map(tuple, reports.totals(runs).collect())),
                     sorted(map(tuple, reports.summary(runs).collect())),
                     [tuple(r) for r in reports.report_lifecycle(runs).df.orderBy("rank").collect()]))
    assert outs[0] == outs[1]
