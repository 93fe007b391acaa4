"""Quarantine: one pass into the store, replay by compare-and-set."""

import json

import pytest
from pyspark.sql import functions as F

from runlens.sources import quarantine
from runlens.sources.quarantine import NOT_JSON, NOT_RECORD, WRONG_TYPE, ingest_logs, quarantined, replay
from runlens.sources.runlogs import scan_runs
from runlens.sources.sinks import append_runs, read_converted, replace_slice
from runlens.sources.store import entries, vacuum


def run(i, provider="STEEL"):
    return {"id": str(i), "provider": provider, "session_creation_ms": float(i), "success": True}


def cut(i, provider="STEEL"):
    return json.dumps(run(i, provider))[:-1]


def brace(line):
    return F.concat(line, F.lit("}"))


def ids(spark, store, kind="lifecycle"):
    return sorted(int(r["id"]) for r in read_converted(spark, store, kind).collect())


@pytest.fixture()
def logs(write_jsonl):
    return write_jsonl({
        "steel.jsonl": [run(1), cut(2), "[1", run(3), "", "   "],
        "kernel.jsonl": [cut(4, "a:b"), "17", json.dumps({**run(5), "session_creation_ms": "x"})],
        "stealth.jsonl": [{"provider": "KERNEL", "mode": "default", "success": True}, "{bad"],
        "notes.txt": ["{not a log"]})


def test_one_pass_keeps_rows_and_bad_lines(spark, logs, tmp_path):
    store = str(tmp_path / "store")
    assert ingest_logs(spark, logs, store, "first")
    assert not ingest_logs(spark, logs, store, "first")
    assert ids(spark, store) == [1, 3]
    bad = {(r["kind"], r["file"].rsplit("/", 1)[1], r["line"], r["reason"]) for r in quarantined(spark, store).collect()}
    assert bad == {
        ("lifecycle", "steel.jsonl", cut(2), NOT_JSON), ("lifecycle", "steel.jsonl", "[1", NOT_JSON),
        ("lifecycle", "kernel.jsonl", cut(4, "a:b"), NOT_JSON), ("lifecycle", "kernel.jsonl", "17", NOT_RECORD),
        ("lifecycle", "kernel.jsonl", json.dumps({**run(5), "session_creation_ms": "x"}), WRONG_TYPE),
        ("stealth", "stealth.jsonl", "{bad", NOT_JSON)}
    assert len(entries(spark, store)) == 1
    # no reader of rows sees the lines
    assert read_converted(spark, store).count() == 3
    assert scan_runs(spark, store).count() == 2 and scan_runs(spark, store, None).count() == 3


def test_replayed_lines_appear_once(spark, logs, tmp_path):
    store = str(tmp_path / "store")
    ingest_logs(spark, logs, store)
    assert replay(spark, store) == 0  # unrepaired: nothing to free, nothing committed
    assert len(entries(spark, store)) == 1
    assert replay(spark, store, brace) == 2
    assert ids(spark, store) == [1, 2, 3, 4]
    assert replay(spark, store, brace) == 0
    assert ids(spark, store) == [1, 2, 3, 4]
    assert {r["provider"] for r in read_converted(spark, store, "lifecycle").collect()} == {"STEEL", "a:b"}
    assert sorted(r["line"] for r in quarantined(spark, store).collect()) == \
        sorted(["[1", "17", "{bad", json.dumps({**run(5), "session_creation_ms": "x"})])
    # a kind at a time
    assert replay(spark, store, lambda line: F.lit(json.dumps({"provider": "KERNEL", "mode": "m"})), ["stealth"]) == 1
    assert read_converted(spark, store, "stealth").count() == 2
    assert {r["kind"] for r in quarantined(spark, store).collect()} == {"lifecycle"}
    vacuum(spark, store, 0)
    assert ids(spark, store) == [1, 2, 3, 4] and quarantined(spark, store).count() == 3


def test_replay_starts_over_after_another_commit(spark, logs, tmp_path, monkeypatch):
    """Lines quarantined by another writer between its read and its commit are not lost."""
    store, late = str(tmp_path / "store"), tmp_path / "late"
    ingest_logs(spark, logs, store)
    late.mkdir()
    (late / "steel.jsonl").write_text(cut(6) + "\n" + json.dumps(run(7)) + "\n")
    real, calls = quarantine.commit, []

    def racing(rows, path, batch_id=None, **how):
        calls.append(how.get("at"))
        if len(calls) == 1:
            monkeypatch.setattr(quarantine, "commit", real)
            ingest_logs(spark, str(late), store)
            monkeypatch.setattr(quarantine, "commit", racing)
        return real(rows, path, batch_id, **how)

    monkeypatch.setattr(quarantine, "commit", racing)
    assert replay(spark, store, brace) == 3
    assert calls == [1, 2]
    assert ids(spark, store) == [1, 2, 3, 4, 6, 7]
    assert quarantined(spark, store).count() == 4


def test_quarantine_lives_beside_other_writers(spark, logs, tmp_path, write_jsonl):
    store = str(tmp_path / "store")
    ingest_logs(spark, logs, store)
    rows = read_converted(spark, store, "lifecycle")
    append_runs(rows.where("id = '1'").withColumn("id", F.lit("8")), store, "lifecycle")
    replace_slice(rows.where("id = '3'"), store, [("lifecycle", "STEEL")])
    assert ids(spark, store) == [3]
    assert quarantined(spark, store).count() == 6
    empty = str(tmp_path / "none")
    assert ingest_logs(spark, str(tmp_path / "nowhere"), empty) and quarantined(spark, empty).count() == 0
    assert replay(spark, empty, brace) == 0
    clean = write_jsonl({"steel.jsonl": [run(1)]}, sub="clean")
    store2 = str(tmp_path / "store2")
    ingest_logs(spark, clean, store2)
    assert ids(spark, store2) == [1] and quarantined(spark, store2).count() == 0
