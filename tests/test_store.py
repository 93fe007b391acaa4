"""The run store: one commit log, versioned slices, text keys."""

import json
import os

import pytest
from pyspark.sql import functions as F

from runlens.sources.runlogs import scan_runs
from runlens.sources.schemas import LIFECYCLE
from runlens.sources.sinks import append_runs, convert_runs, read_converted, replace_slice
from runlens.sources.store import entries, vacuum
from runlens.streaming.ingest import ingest_runs, stream_runs

KEYS = ["007", "010", "a:b", "a/b", "x=y", "%", "%3A", "", None, "_empty_", "__HIVE_DEFAULT_PARTITION__", "é ü", "A"]


def life(spark, rows):
    return spark.createDataFrame([("t", None, 1.0, 1.0, float(ms), 1.0, p, True, None, None) for p, ms in rows], LIFECYCLE)


def got(spark, path, **kw):
    return sorted(((r.provider, r.page_goto_ms) for r in read_converted(spark, path, "lifecycle", **kw).collect()), key=repr)


def rows(pairs):
    return sorted(((p, float(ms)) for p, ms in pairs), key=repr)


def test_keys_stay_text_and_any_slice_can_be_emptied(spark, tmp_path):
    store = str(tmp_path / "s")
    have = [(k, i) for i, k in enumerate(KEYS)]
    append_runs(life(spark, have), store, "lifecycle")
    assert got(spark, store) == rows(have)
    assert read_converted(spark, store).schema["provider"].dataType.simpleString() == "string"
    assert got(spark, store, providers=["007", "a:b", ""]) == rows(x for x in have if x[0] in ("007", "a:b", ""))
    gone = ["a:b", "a/b", "x=y", "%", None, "", "007"]
    replace_slice(life(spark, []), store, [("lifecycle", k) for k in gone], "lifecycle")
    assert got(spark, store) == rows(x for x in have if x[0] not in gone)
    append_runs(life(spark, [("", 70), (None, 71)]), store, "lifecycle")  # later rows of an emptied slice count
    assert got(spark, store) == rows([x for x in have if x[0] not in gone] + [("", 70), (None, 71)])


def test_a_slice_is_replaced_by_rows_read_from_itself(spark, tmp_path):
    store = str(tmp_path / "s")
    append_runs(life(spark, [("a", 1), ("a", 2), ("b", 3)]), store, "lifecycle")
    own = read_converted(spark, store, "lifecycle", ["a"])
    replace_slice(own.where("page_goto_ms > 1"), store, [("lifecycle", "a")])
    assert got(spark, store) == rows([("a", 2), ("b", 3)])
    replace_slice(life(spark, [("b", 9), ("c", 10)]), store, None, "lifecycle")
    assert got(spark, store) == rows([("a", 2), ("b", 9), ("c", 10)])


def test_a_failed_write_leaves_the_store_as_it_was(spark, tmp_path):
    store = str(tmp_path / "s")
    append_runs(life(spark, [("a", 1), ("b", 3)]), store, "lifecycle")
    bad = life(spark, [("a", 5), ("a", 6)]).withColumn(
        "page_goto_ms", F.when(F.col("page_goto_ms") == 6, F.raise_error(F.lit("lost")).cast("double")).otherwise(F.col("page_goto_ms")))
    for write in (lambda: replace_slice(bad, store, [("lifecycle", "a")], "lifecycle"), lambda: append_runs(bad, store, "lifecycle"),
                  lambda: convert_runs(bad.withColumn("kind", F.lit("lifecycle")), store)):
        with pytest.raises(Exception):
            write()
        assert got(spark, store) == rows([("a", 1), ("b", 3)])


def test_append_with_one_id_is_once(spark, tmp_path):
    store = str(tmp_path / "s")
    assert append_runs(life(spark, [("a", 1)]), store, "lifecycle", batch_id="x")
    assert not append_runs(life(spark, [("a", 1)]), store, "lifecycle", batch_id="x")
    assert append_runs(life(spark, [("a", 1)]), store, "lifecycle")
    assert got(spark, store) == rows([("a", 1), ("a", 1)])
    assert [e.version for e in entries(spark, store)] == [1, 2]


def test_unpublished_batches_are_not_read_and_vacuum_removes_them(spark, tmp_path):
    store = str(tmp_path / "s")
    append_runs(life(spark, [("a", 1)]), store, "lifecycle")
    life(spark, [("a", 2)]).withColumn("kind", F.lit("lifecycle")).write.partitionBy("kind", "provider").parquet(f"{store}/batch=half")
    assert got(spark, store) == rows([("a", 1)])
    assert vacuum(spark, store) == []  # may still be written
    assert vacuum(spark, store, grace_s=-1) == ["half"]
    convert_runs(life(spark, [("b", 4)]).withColumn("kind", F.lit("lifecycle")), store)
    assert got(spark, store) == rows([("b", 4)]) and len(vacuum(spark, store)) == 1
    assert got(spark, store) == rows([("b", 4)])


def test_stream_and_batch_writers_share_the_log(spark, tmp_path):
    src, store, ckpt = tmp_path / "results", str(tmp_path / "s"), str(tmp_path / "ckpt")
    src.mkdir()
    (src / "kernel.jsonl").write_text(json.dumps({"created_at": "t", "provider": "007", "page_goto_ms": 1, "success": True}) + "\n")
    ingest_runs(stream_runs(spark, str(src), "lifecycle"), store, ckpt).awaitTermination(120)
    append_runs(life(spark, [("B", 2)]), store, "lifecycle")
    assert got(spark, store) == rows([("007", 1), ("B", 2)])
    assert scan_runs(spark, store, "lifecycle").count() == 2
    # the first trigger once more, as after a failure before Spark noted it
    append_runs(life(spark, [("007", 1)]), store, "lifecycle", batch_id=f"{ckpt}#0")
    assert got(spark, store) == rows([("007", 1), ("B", 2)])


def test_read_opens_no_footer_and_prunes(spark, tmp_path):
    store = str(tmp_path / "s")
    append_runs(life(spark, [("a", 1), ("b", 2)]), store, "lifecycle")
    for top, _, names in os.walk(f"{store}/batch={entries(spark, store)[0].batch}/kind=lifecycle/provider=b"):
        for n in names:  # unreadable: any footer read or unpruned scan fails
            open(os.path.join(top, n), "w").write("no parquet")
    assert got(spark, store, providers=["a"]) == rows([("a", 1)])
    df = read_converted(spark, store, "lifecycle").where("provider = 'a'")
    assert [r.page_goto_ms for r in df.collect()] == [1.0]
    assert "PartitionFilters: [" in df._jdf.queryExecution().executedPlan().toString()


def test_missing_or_empty_store(spark, tmp_path):
    assert read_converted(spark, str(tmp_path / "none"), "lifecycle").count() == 0
    store = str(tmp_path / "s")
    append_runs(life(spark, []), store, "lifecycle")
    assert got(spark, store) == [] and scan_runs(spark, store).count() == 0


def test_rows_from_before_the_log(spark, tmp_path):
    """A folder partitioned by kind and provider: read, appended to, replaced in part and whole."""
    out = str(tmp_path / "old")
    old = spark.createDataFrame([("a", "1"), ("007", "2")], "provider string, id string").withColumn("kind", F.lit("lifecycle"))
    old.write.partitionBy("kind", "provider").parquet(out)
    read = lambda: sorted((r["provider"], r["id"]) for r in read_converted(spark, out, "lifecycle").collect())
    assert read() == [("007", "2"), ("a", "1")]
    new = spark.createDataFrame([("a", "3")], "provider string, id string")
    append_runs(new, out, "lifecycle")
    assert read() == [("007", "2"), ("a", "1"), ("a", "3")]
    replace_slice(new, out, [("lifecycle", "a")], "lifecycle")
    assert read() == [("007", "2"), ("a", "3")]
    convert_runs(new.withColumn("kind", F.lit("lifecycle")), out)
    assert read() == [("a", "3")]
