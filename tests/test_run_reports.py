"""End to end: a results folder with every kind -> all tables written."""

import json

import pytest

from runlens.plans.run_reports import build


def test_all_reports_from_one_folder(spark, tmp_path):
    d = tmp_path / "results"
    d.mkdir()

    def w(name, rows):
        (d / name).write_text("\n".join(json.dumps(r) for r in rows) + "\n")

    w("kernel.jsonl", [{"created_at": f"2026-03-06T00:00:0{i}.000Z", "provider": "KERNEL",
                        "session_creation_ms": 200 + i, "session_connect_ms": 800, "page_goto_ms": 270,
                        "session_release_ms": 240, "success": True} for i in range(5)])
    w("idle-kernel.jsonl", [{"created_at": "2026-03-06T00:00:00.000Z", "provider": "KERNEL", "step1_ms": 1602,
                             "idle_ms": 60000, "session_survived": True, "step2_ms": 248,
                             "session_release_ms": 300, "total_ms": 62800, "success": True}])
    w("stealth.jsonl", [{"created_at": "2026-03-06T00:00:00.000Z", "provider": "KERNEL", "mode": m,
                         "sannysoft_webdriver_detected": False, "sannysoft_headless_detected": False,
                         "areyouheadless_detected": False, "recaptcha_score": 0.3, "success": True}
                        for m in ("default", "stealth")])
    w("captcha.jsonl", [{"created_at": "2026-03-06T00:00:00.000Z", "provider": "KERNEL", "supported": True,
                         "captcha_detected": True, "captcha_solved": True, "solve_ms": 38500.0,
                         "success": False}])
    w("parallel-kernel.jsonl", [{"created_at": "t", "provider": "KERNEL", "run": 1, "concurrency": 3,
                                 "sequential_mode": False, "sessions": [], "sessions_succeeded": 3,
                                 "sessions_failed": 0, "total_parallel_ms": 1000,
                                 "sequential_equivalent_ms": 2655, "overhead_ratio": 0.3766,
                                 "success": True}])
    out = build(spark, str(d))
    status = {r["section"]: (r["n_rows"], r["state"]) for r in out["status"].collect()}
    assert all(r["bad_lines"] == 0 for r in out["status"].collect())
    assert status == {"lifecycle": (1, "ok"), "idle": (1, "ok"), "stealth": (2, "ok"),
                      "captcha": (0, "has_errors"), "parallel": (1, "ok")}
    # compat totals read every file of the glob: every successful row of any kind is a run
    assert out["totals"].first()["runs"] == 5 + 1 + 2 + 1  # lifecycle, idle, stealth, parallel
    assert build(spark, str(d), strict=True)["totals"].first()["runs"] == 5
    assert out["report_lifecycle"].first()["avg_total"] == "1512ms"
    assert out["parallel_summary"].first()["avg_overhead_ratio"] == 0.3766
    assert out["idle_rows"].first()["total_s"] == 62.8


def test_bad_lines_change_no_table(spark, tmp_path):
    d = tmp_path / "results"
    d.mkdir()
    good = json.dumps({"created_at": "t", "provider": "KERNEL", "run": 1, "concurrency": 3, "sequential_mode": False,
                       "sessions": [], "sessions_succeeded": 3, "sessions_failed": 0, "total_parallel_ms": 1000.5,
                       "sequential_equivalent_ms": 2655, "overhead_ratio": 0.3766, "success": True})
    (d / "parallel-kernel.jsonl").write_text(good + "\n")
    before = build(spark, str(d))
    tables = {k: sorted(map(str, v.collect())) for k, v in before.items() if k != "status"}
    (d / "parallel-steel.jsonl").write_text(good[:-20] + "\n")
    after = build(spark, str(d))
    assert {k: sorted(map(str, v.collect())) for k, v in after.items() if k != "status"} == tables
    assert {r["section"]: r["bad_lines"] for r in after["status"].collect()}["parallel"] == 1
    with pytest.raises(Exception):
        build(spark, str(d), bad_lines="failfast")


def test_missing_folder_fails(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        build(spark, str(tmp_path / "reslts"))


def test_cli_writes_every_table(spark, tmp_path):
    import os
    from runlens.plans.run_reports import main
    d = tmp_path / "results"
    d.mkdir()
    (d / "steel.jsonl").write_text(json.dumps(
        {"created_at": "2026-03-06T00:00:00.000Z", "provider": "STEEL", "session_creation_ms": 290,
         "session_connect_ms": 760, "page_goto_ms": 209, "session_release_ms": 181, "success": True}) + "\n")
    out = tmp_path / "out"
    main([str(d), str(out), "--format", "json"])
    assert sorted(os.listdir(out)) == sorted(
        ["totals", "summary", "idle_rows", "parallel_summary", "report_lifecycle", "report_idle",
         "report_stealth", "report_captcha", "report_parallel", "status"])
    rows = spark.read.json(str(out / "report_lifecycle")).collect()
    assert [(r["provider"], r["avg_total"]) for r in rows] == [("STEEL", "1440ms")]
