"""Batch rollups: sessions -> batch counters, sequential-equivalent time and
overhead ratio; batch summary per (provider, mode, concurrency).

Two shapes of the same rollup:
  rows   one row per session: grouped by batch (partial aggregation before
         the shuffle, so a huge batch costs one partial row per map task);
  nested one record per batch (or per part of a batch) with an array of
         sessions: array functions, no shuffle; ``combine_rollups`` adds up
         the parts of a batch stored as several records.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runlens.functions._col import col
from runlens.functions.numeric import dround, measure
from runlens.operators.quantiles import value_stats


def rollup_rows(sessions: DataFrame, batch_keys: list[str], ok: str = "success",
                ms: str = "session_total_ms") -> DataFrame:
    """Per batch: n_sessions, sessions_succeeded, sessions_failed (NULL success
    counts as failed), sequential_equivalent_ms = sum of ms with NULL as 0,
    success = no failed session."""
    good = F.coalesce(F.col(ok), F.lit(False))
    agg = sessions.groupBy(*batch_keys).agg(
        F.count(F.lit(1)).alias("n_sessions"),
        F.count_if(good).alias("sessions_succeeded"),
        F.count_if(~good).alias("sessions_failed"),
        F.sum(F.coalesce(F.col(ms), F.lit(0))).alias("sequential_equivalent_ms"))
    return agg.withColumn("success", F.col("sessions_failed") == 0)


def fill_empty_batches(df: DataFrame, ms_type: T.DataType = T.LongType()) -> DataFrame:
    """After a batch LEFT JOIN rollup: a batch without sessions has 0 of everything
    and counts as successful (no failed session)."""
    return (df.withColumn("n_sessions", F.coalesce("n_sessions", F.lit(0).cast("long")))
              .withColumn("sessions_succeeded", F.coalesce("sessions_succeeded", F.lit(0).cast("long")))
              .withColumn("sessions_failed", F.coalesce("sessions_failed", F.lit(0).cast("long")))
              .withColumn("sequential_equivalent_ms",
                          F.coalesce("sequential_equivalent_ms", F.lit(0).cast(ms_type)))
              .withColumn("success", F.coalesce("success", F.lit(True))))


def rollup_nested(batches: DataFrame, sessions: str = "sessions", ok: str = "success",
                  ms: str = "session_total_ms") -> DataFrame:
    """Same counters as ``rollup_rows``, computed inside each batch's array."""
    elem = batches.schema[sessions].dataType.elementType
    ms_type = elem[ms].dataType
    arr = F.coalesce(F.col(sessions), F.array().cast(T.ArrayType(elem)))
    good = lambda s: F.coalesce(s[ok], F.lit(False))
    return (batches
            .withColumn("n_sessions", F.size(arr).cast("long"))
            .withColumn("sessions_succeeded", F.size(F.filter(arr, good)).cast("long"))
            .withColumn("sessions_failed", F.size(F.filter(arr, lambda s: ~good(s))).cast("long"))
            .withColumn("sequential_equivalent_ms",
                        F.aggregate(arr, F.lit(0).cast(ms_type),
                                    lambda acc, s: acc + F.coalesce(s[ms], F.lit(0).cast(ms_type))))
            .withColumn("success", F.col("sessions_failed") == 0))


def combine_rollups(records: DataFrame, batch_keys: list[str]) -> DataFrame:
    """Batch counters from several records of the same batch (e.g. a batch
    stored as several nested records): counts and sums add up, and the batch
    succeeded when no record has a failed session. Partially aggregated, so a
    batch with many records costs one partial row per map task."""
    return (records.groupBy(*batch_keys).agg(
                F.sum("n_sessions").cast("long").alias("n_sessions"),
                F.sum("sessions_succeeded").cast("long").alias("sessions_succeeded"),
                F.sum("sessions_failed").cast("long").alias("sessions_failed"),
                F.sum("sequential_equivalent_ms").alias("sequential_equivalent_ms"))
            .withColumn("success", F.col("sessions_failed") == 0))


def overhead_ratio(wall: Column | str, seq: Column | str, places: int = 4) -> Column:
    """wall / sequential-equivalent, rounded; NULL when the sum is 0 or wall is NULL."""
    wall, seq = col(wall), col(seq)
    return F.when((seq > 0) & wall.isNotNull(),
                  dround(wall.cast("double") / seq.cast("double"), places))


def batch_summary(batches: DataFrame, keys: list[str] = ["provider", "sequential_mode", "concurrency"]
                  ) -> DataFrame:
    """Batches per (provider, sequential_mode, concurrency): runs, avg sessions
    succeeded, avg / median wall time, avg sequential equivalent, avg overhead
    ratio, failed batches. Ratios count to four places, as records carry them,
    and are summed as whole ten-thousandths: no order of summing changes the mean."""
    ratio = F.round(measure(batches, "overhead_ratio") * 10000, 0)
    out = value_stats(
        batches, keys, measure(batches, "total_parallel_ms"), {"p50_parallel_ms": 0.5},
        sums={"runs": F.lit(1), "failed_batches": F.when(F.col("success"), 0).otherwise(1)},
        means={"avg_succeeded": measure(batches, "sessions_succeeded"),
               "avg_seq_equiv_ms": measure(batches, "sequential_equivalent_ms"),
               "avg_overhead_ratio": ratio},
        mean="avg_parallel_ms")
    rest = [k for k in keys if k != "concurrency"]
    return out.select(*rest, "runs", dround("avg_succeeded", 1).alias("avg_succeeded"),
                      F.col("concurrency").alias("max_sessions"),
                      dround("avg_parallel_ms", 0).alias("avg_parallel_ms"),
                      dround("p50_parallel_ms", 0).alias("p50_parallel_ms"),
                      dround("avg_seq_equiv_ms", 0).alias("avg_seq_equiv_ms"),
                      dround(F.col("avg_overhead_ratio") / 10000, 4).alias("avg_overhead_ratio"),
                      "failed_batches")
