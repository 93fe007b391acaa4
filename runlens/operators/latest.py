"""Latest-record selection and sibling lookups.

``row_number() ... = 1`` is planned as a WindowGroupLimit: each input
partition keeps only its top row per key before the shuffle, so a key with a
large share of rows sends one row per map task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_RN = "_rl_rn"


def _desc(names: list[str]) -> list[Column]:
    return [F.col(n).desc_nulls_last() for n in names]


def latest_per_key(df: DataFrame, keys: list[str], ts: str = "created_at",
                   tie: list[str] | None = None) -> DataFrame:
    """Newest row per key (``ORDER BY ts DESC`` with NULL times last); ``tie``
    columns (descending) make the choice deterministic when times are equal."""
    w = Window.partitionBy(*keys).orderBy(*_desc([ts] + (tie or [])))
    return df.withColumn(_RN, F.row_number().over(w)).where(F.col(_RN) == 1).drop(_RN)


def latest_with_fallback(df: DataFrame, keys: list[str], success: str = "success",
                         ts: str = "created_at", tie: list[str] | None = None) -> DataFrame:
    """Latest successful row per key, else the latest failed row.

    A success wins even when it is older than the newest failure. Rows whose
    success flag is NULL belong to neither set. One window, no self-join.
    """
    d = df.where(F.col(success).isNotNull())
    w = Window.partitionBy(*keys).orderBy(F.col(success).desc(), *_desc([ts] + (tie or [])))
    return d.withColumn(_RN, F.row_number().over(w)).where(F.col(_RN) == 1).drop(_RN)


def sibling_values(df: DataFrame, keys: list[str], mode: str, modes: dict[str, str],
                   fields: list[str]) -> DataFrame:
    """Pivot at most one row per (keys, mode) into columns, one set per mode.

    ``modes`` maps an output prefix to a mode value. Output: keys,
    ``has_<prefix>`` and ``<prefix>_<field>`` for each field. A conditional
    aggregate per key instead of a self-join.
    """
    aggs = []
    for prefix, value in modes.items():
        hit = F.col(mode) == F.lit(value)
        aggs.append(F.coalesce(F.max(F.when(hit, F.lit(True))), F.lit(False)).alias(f"has_{prefix}"))
        aggs += [F.max(F.when(hit, F.col(f))).alias(f"{prefix}_{f}") for f in fields]
    return df.groupBy(*keys).agg(*aggs)


def distinct_keys(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct keys present in either set."""
    return a.select(*keys).unionByName(b.select(*keys)).distinct()


def any_failure(df: DataFrame, keys: list[str] | None = None, success: str = "success") -> DataFrame:
    """``any_failure`` per key (or overall): some row whose success is not true."""
    failed = ~F.coalesce(F.col(success), F.lit(False))
    g = df.groupBy(*keys) if keys else df.groupBy()
    return g.agg(F.coalesce(F.bool_or(failed), F.lit(False)).alias("any_failure"))
