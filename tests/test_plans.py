"""Physical-plan checks: the shapes the operators are designed to produce."""

import pytest
from pyspark.sql import functions as F

from runlens.operators.latest import latest_per_key, latest_with_fallback
from runlens.operators.order import with_position
from runlens.operators.stats import stage_summary
from runlens.sources.sinks import read_converted
from runlens.sources.schemas import LIFECYCLE


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def runs(spark, n=200):
    rows = [{"created_at": f"2026-03-0{1 + i % 9}T00:00:00.000Z", "id": str(i), "session_creation_ms": float(i),
             "session_connect_ms": float(i % 7), "page_goto_ms": 3.0, "session_release_ms": None if i % 5 else 1.0,
             "provider": "P" if i % 3 else "Q", "success": i % 4 != 0, "error_stage": None,
             "error_message": None} for i in range(n)]
    return spark.createDataFrame(rows, LIFECYCLE)


def test_latest_per_key_limits_before_shuffle(spark):
    p = plan(latest_per_key(runs(spark), ["provider"], tie=["id"]))
    assert p.count("WindowGroupLimit") == 2  # partial (map side) and final
    p = plan(latest_with_fallback(runs(spark), ["provider"], tie=["id"]))
    assert p.count("WindowGroupLimit") == 2


def test_ranking_has_no_global_window_over_rows(spark):
    """Only the table with a row per partition is numbered in one window."""
    p = plan(with_position(runs(spark), ["provider", "id"]))
    assert "row_number" not in p
    p = plan(stage_summary(runs(spark)))
    assert "BroadcastExchange" not in p or "SinglePartition" not in p.split("BroadcastExchange")[0]


def test_converted_store_prunes_partitions(spark, tmp_path):
    out = str(tmp_path / "store")
    runs(spark).withColumn("kind", F.lit("lifecycle")).write.partitionBy("kind", "provider").parquet(out)
    df = read_converted(spark, out, "lifecycle", ["Q"]).select("session_creation_ms")
    p = plan(df)
    assert "PartitionFilters: [isnotnull(kind" in p and "provider" in p
    assert "ReadSchema: struct<session_creation_ms:double>" in p
    assert df.count() == 67


def test_checkpoint_folder_must_be_shared(monkeypatch):
    import types

    from runlens import session

    class Conf:
        def get(self, *a):
            return None

    def fake(master, dir_=None):
        state = {"dir": dir_}
        sc = types.SimpleNamespace(master=master, getCheckpointDir=lambda: state["dir"], getConf=lambda: Conf(),
                                   setCheckpointDir=lambda d: state.update(dir=d))
        return types.SimpleNamespace(sparkContext=sc, conf=Conf())

    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError):
            session.shared_dir(fake(master))
        assert session.shared_dir(fake(master, "hdfs:///c")) == "hdfs:///c"
    assert "runlens-ckpt-" in session.shared_dir(fake("local[2]"))


def test_scratch_tables_are_removed(spark):
    from runlens.session import path_exists, remove_path, scratch_path

    path = scratch_path(spark, "x")
    spark.range(3).write.parquet(path)
    assert path_exists(spark, path)
    remove_path(spark, path)
    assert not path_exists(spark, path)
    remove_path(spark, path)
