"""Writers: the run store (append, replace slices, convert logs) and report tables.

The store (``store.py``) is Parquet by kind and provider behind a commit log. Everything
that writes runs, batch or streaming, commits to that one log, and ``read_converted`` and
``runlogs.scan_runs`` read it back.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.sources.store import commit, read_store


def _store(df: DataFrame, kind: str | None) -> DataFrame:
    return df if kind is None else df.withColumn("kind", F.lit(kind))


def append_runs(df: DataFrame, path: str, kind: str | None = None, batch_id: str | None = None) -> bool:
    """Append records to the store (``kind`` for frames without that column).

    A ``batch_id`` that was committed before adds nothing (returns False), so a retry is safe.
    """
    return commit(_store(df, kind), path, batch_id)


def replace_slice(df: DataFrame, path: str, slices: list[tuple[str, str]] | None = None,
                  kind: str | None = None, batch_id: str | None = None) -> bool:
    """Replace the named (kind, provider) slices by what ``df`` has of them.

    A slice named in ``slices`` that ``df`` has no row of ends up empty. Without
    ``slices``, those present in ``df`` are replaced (their names are looked up first: a
    second pass over ``df``). Other slices stay. Old rows are hidden when the new ones are
    published, in one step; ``df`` may itself be read from the slices it replaces.
    """
    rows = _store(df, kind)
    if slices is None:
        slices = [(r.kind, r.provider) for r in rows.select("kind", "provider").distinct().collect()]  # keys, not rows
    named = [F.col("kind").eqNullSafe(F.lit(k)) & F.col("provider").eqNullSafe(F.lit(p)) for k, p in slices]
    wanted = reduce(Column.__or__, named, F.lit(False))
    return commit(rows.where(wanted), path, batch_id, slices=slices)


def convert_runs(df: DataFrame, path: str, batch_id: str | None = None) -> bool:
    """Store scanned run logs (with their ``kind``), replacing the whole store:
    partition pruning takes the place of file-name globs."""
    return commit(df, path, batch_id, everything=True)


def read_converted(spark, path: str, kind: str | None = None,
                   providers: list[str] | None = None) -> DataFrame:
    """Read the store. Kind and provider predicates are partition filters: only
    matching folders are read. Fields that no file has are NULL."""
    return read_store(spark, path, kind, providers)


def write_report(df: DataFrame, path: str, fmt: str = "parquet", files: int | None = None) -> None:
    """Write one table as it is partitioned (AQE merges small partitions);
    ``files`` asks for at most that many files."""
    out = df.coalesce(files) if files else df
    out.write.mode("overwrite").format(fmt).option("header", "true").save(path)


def to_json_text(df: DataFrame, cols: list[str] | None = None, out: str = "json") -> DataFrame:
    """Record -> JSON text with NULL fields kept (``JSON.stringify`` keeps nulls)."""
    cols = cols or df.columns
    return df.withColumn(out, F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}))
