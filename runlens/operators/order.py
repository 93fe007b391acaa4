"""Ordering operators: positions in a sorted result and custom sort keys.

``with_position`` numbers rows 1..n in a total order, the same way at every
size: the rows are range-partitioned and sorted, that one copy is checkpointed
to the shared folder, each partition numbers its own rows, and a table with one
row per partition (bounded by the partition count) supplies the offsets. No
task ever holds more than one range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from runlens.functions._col import col
from runlens.session import shared_dir

_PID, _MID, _N, _FIRST, _OFF = "_rl_pid", "_rl_mid", "_rl_n", "_rl_first", "_rl_off"


def snapshot(df: DataFrame) -> DataFrame:
    """Checkpoint ``df`` to the shared folder: later passes read this copy, so a
    recomputation (e.g. after a lost executor) cannot re-split or reorder rows."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def range_sorted(df: DataFrame, order: list[Column], num_partitions: int | None = None,
                 watch: tuple[Observation, list[Column]] | None = None) -> DataFrame:
    """Globally sort ``df`` by ``order`` and tag each row with its partition id and
    a per-partition increasing id, then checkpoint so every later use sees the
    same partitioning (range bounds come from sampling, which may differ
    between two executions). ``watch`` (an observation and its aggregates) is filled by
    the pass that writes the checkpoint: behind the shuffle, where a task counts once
    however often the stages before it are run again."""
    # without an explicit count AQE may coalesce the range partitions; they stay
    # contiguous and ordered, which is all the offsets below rely on
    ranged = (df.repartitionByRange(num_partitions, *order) if num_partitions
              else df.repartitionByRange(*order))
    tagged = (ranged
              .sortWithinPartitions(*order)
              .withColumn(_PID, F.spark_partition_id())
              .withColumn(_MID, F.monotonically_increasing_id()))
    if watch is not None:
        tagged = tagged.observe(watch[0], *watch[1])
    return snapshot(tagged)


def with_position(df: DataFrame, order: list[Column | str], name: str = "position",
                  num_partitions: int | None = None,
                  watch: tuple[Observation, list[Column]] | None = None) -> DataFrame:
    """Add ``name`` = 1-based position (bigint) of each row in ``order``.

    ``order`` must be a total order (end it with a unique tie-break column) for
    the positions to be deterministic. The result reads the checkpointed sorted
    copy, so further passes over it don't compute ``df`` again. ``watch``: aggregates
    over ``df`` taken in the same pass (see ``range_sorted``).
    """
    srt = range_sorted(df, [col(o) for o in order], num_partitions, watch)
    counts = srt.groupBy(_PID).agg(F.count(F.lit(1)).alias(_N), F.min(_MID).alias(_FIRST))
    # one row per partition: bounded by the partition count, safe to broadcast
    before = Window.orderBy(_PID).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(_PID, _FIRST,
                            F.coalesce(F.sum(_N).over(before), F.lit(0)).alias(_OFF))
    pos = (F.col(_OFF) + (F.col(_MID) - F.col(_FIRST)) + F.lit(1)).cast("long")
    return (srt.join(F.broadcast(offsets), _PID)
            .withColumn(name, pos)
            .drop(_PID, _MID, _FIRST, _OFF)
            .sortWithinPartitions(name))


def enum_rank(c: Column | str, values: list[str], default: int = 99) -> Column:
    """Sort key from a fixed list: position (1-based) of the value, else ``default``."""
    c = col(c)
    out = None
    for i, v in enumerate(values, start=1):
        out = F.when(c == v, F.lit(i)) if out is None else out.when(c == v, F.lit(i))
    return out.otherwise(F.lit(default)) if out is not None else F.lit(default)


def survivor_key(survived: Column | str) -> Column:
    """0 when survived is exactly true, else 1 (false and NULL sort after)."""
    return F.when(col(survived) == F.lit(True), F.lit(0)).otherwise(F.lit(1))


def captcha_order(supported: Column | str, solve_s: Column | str, plan_rank: Column,
                  key: Column | str) -> list[Column]:
    """Report order of the captcha table: supported first; unsupported rows by
    plan order; supported rows by solve time with a missing time read as 0 (a
    timeout sorts first); ties fall back to (solve time NULLS LAST, key)."""
    sup = F.coalesce(col(supported), F.lit(False))
    second = F.when(sup, F.coalesce(col(solve_s).cast("double"), F.lit(0.0))) \
              .otherwise(plan_rank.cast("double"))
    return [col(supported).desc_nulls_last(), second, col(solve_s).asc_nulls_last(),
            col(key).asc_nulls_last()]
