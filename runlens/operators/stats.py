"""Per-key statistics over run rows.

Every aggregate here (count, avg, stddev, conditional counts) is partially
aggregated before the shuffle, so a key holding a large share of the rows
costs one partial row per input partition. Quantiles, and what is asked for
beside them, come from one pass of ``quantiles.value_stats``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.functions.numeric import dround, measure, row_total
from runlens.operators.quantiles import value_stats

# The four lifecycle stages and the row total, in report order.
STAGES = ["session_creation_ms", "session_connect_ms", "page_goto_ms", "session_release_ms"]
TOTAL = "total_ms"
METRIC_ORDER = STAGES + [TOTAL]


def is_true(c: Column | str) -> Column:
    """success = true; NULL counts as not true."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(c, F.lit(False))


def complete_rows(df: DataFrame, cols: list[str]) -> DataFrame:
    """Rows where every listed column is non-NULL."""
    return df.dropna(how="any", subset=cols)


def with_stage_doubles(df: DataFrame, stages: list[str] = STAGES, total: str | None = TOTAL) -> DataFrame:
    """Cast the stages to double and add the strict row total."""
    out = df.select(*[c for c in df.columns if c not in stages],
                    *[measure(df, s).alias(s) for s in stages])
    if total:
        out = out.withColumn(total, row_total(stages, strict=True))
    return out


def stage_totals(runs: DataFrame, keys: list[str] = ["provider"], stages: list[str] = STAGES,
                 success: str = "success", places: int = 0) -> DataFrame:
    """Successful runs per key: count, avg and median of the row total, avg per stage.

    Output: keys, runs, avg_total_ms, median_total_ms, avg_create_ms,
    avg_connect_ms, avg_goto_ms, avg_release_ms (names follow the 4-stage
    lifecycle; any four stage columns can be passed).
    """
    ok = with_stage_doubles(runs.where(F.col(success) == F.lit(True)), stages)
    names = ["avg_create_ms", "avg_connect_ms", "avg_goto_ms", "avg_release_ms"]
    out = value_stats(ok, keys, TOTAL, {"median_total_ms": 0.5}, sums={"runs": F.lit(1)},
                      means={n: F.col(s) for s, n in zip(stages, names)}, mean="avg_total_ms")
    rounded = ["avg_total_ms", "median_total_ms"] + names
    return out.select(*keys, "runs", *[dround(c, places).alias(c) for c in rounded])


def success_rate(df: DataFrame, keys: list[str] = ["provider"], success: str = "success") -> DataFrame:
    """keys, success_rate (percent, NULL success counts as failure), row_count."""
    return df.groupBy(*keys).agg(
        (F.lit(100.0) * F.avg(F.when(F.col(success), 1).otherwise(0))).alias("success_rate"),
        F.count(F.lit(1)).alias("row_count"))


def run_tally(df: DataFrame, keys: list[str] = ["provider"], success: str = "success") -> DataFrame:
    """keys, n_success, n_failure (NULL success counts as a failure)."""
    ok = is_true(success)
    return df.groupBy(*keys).agg(F.count_if(ok).alias("n_success"), F.count_if(~ok).alias("n_failure"))


def unpivot_stages(df: DataFrame, ids: list[str], stages: list[str],
                   metric: str = "metric", value: str = "value") -> DataFrame:
    """Wide -> long: one (ids, metric, value) row per stage; NULL values kept.

    One scan feeding an ``Expand`` instead of one scan per stage.
    """
    wide = df.select(*ids, *[measure(df, s).alias(s) for s in stages])
    return wide.unpivot(ids, stages, metric, value)


def _rate_side(keys: list[str], c: Column) -> Column:
    """A rate column taken from the right side of ``LEFT JOIN ... USING (keys)``:
    a NULL key finds no partner there, so the value is NULL."""
    present = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    return F.when(present, c)


def stats_with_rate(runs: DataFrame, keys: list[str] = ["provider"], stages: list[str] = STAGES,
                    success: str = "success", places: int = 1) -> DataFrame:
    """Statistics of successful runs' totals LEFT JOIN the success rate of all runs.

    Written as one conditional aggregate over all rows, which equals the left
    join of the two aggregates: a key with no successful run has no stats row
    and is dropped, as the left side of the join would drop it.
    """
    wide = with_stage_doubles(runs.select(*keys, success, *stages), stages)
    ok = F.col(success) == F.lit(True)
    agg = wide.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("row_count"),
        (F.lit(100.0) * F.avg(F.when(F.col(success), 1).otherwise(0))).alias("success_rate"),
        F.count_if(ok).alias("n_success"),
        F.avg(F.when(ok, F.col(TOTAL))).alias("avg_total_ms"))
    return (agg.where(F.col("n_success") > 0)
            .select(*keys, _rate_side(keys, F.col("row_count")).alias("row_count"),
                    _rate_side(keys, dround("success_rate", 1)).alias("success_pct"),
                    "n_success", dround("avg_total_ms", places).alias("avg_total_ms")))


def stage_summary(runs: DataFrame, keys: list[str] = ["provider"], stages: list[str] = STAGES,
                  success: str = "success", places: int = 0) -> DataFrame:
    """keys x metric: row_count, success_pct, avg, median, p95, stddev.

    Statistics are over successful runs, the rate over all runs; a key without
    a successful run has no rows (the stats side of the left join is empty).
    The runs are read once and unpivoted (an ``Expand``); the rate's counts are
    sums beside the statistics, the same for each metric of a key.
    """
    ok = F.col(success) == F.lit(True)
    wide = with_stage_doubles(runs.select(*keys, success, *stages), stages)
    long = wide.unpivot(keys + [success], stages + [TOTAL], "metric", "value")
    out = value_stats(long, keys + ["metric"], "value", {"median_ms": 0.5, "p95_ms": 0.95},
                      sums={"row_count": F.lit(1), "_n_ok": ok.cast("int")},
                      means={"_rate": F.when(F.col(success), 1).otherwise(0)},
                      mean="avg_ms", stddev="stddev_ms", where=ok)
    out = out.where(F.col("_n_ok") > 0).withColumn("success_rate", F.lit(100.0) * F.col("_rate"))
    return out.select(*keys, _rate_side(keys, F.col("row_count")).alias("row_count"),
                      _rate_side(keys, dround("success_rate", 1)).alias("success_pct"), "metric",
                      *[dround(c, places).alias(c) for c in ("avg_ms", "median_ms", "p95_ms", "stddev_ms")])
