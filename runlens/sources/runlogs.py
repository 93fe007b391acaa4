"""NDJSON run-log scans.

* explicit schema per kind, missing fields read as NULL;
* kind routing by file name (``_metadata.file_name`` + regex, look-ahead
  included), so one directory can hold every kind;
* ``strict`` keeps only the wanted kind; ``compat`` keeps every row of the
  glob, as a bare ``*.jsonl`` scan would;
* a folder of the run store (``store``) is read as well, beside log files;
* a missing directory gives an empty typed DataFrame, not an error;
* bad lines: ``failfast`` raises, ``quarantine`` splits them off.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runlens.sources.schemas import KIND_SCHEMAS, merged_schema
from runlens.sources.store import is_store, read_store

# File-name patterns of each kind (lifecycle files are the rest).
KIND_PATTERNS = {
    "idle": r"^idle-.*\.jsonl$",
    "stealth": r"^stealth\.jsonl$",
    "captcha": r"^captcha\.jsonl$",
    "parallel": r"^parallel-.*\.jsonl$",
    "lifecycle": r"^(?!idle-|stealth|captcha|parallel-).*\.jsonl$",
}
CORRUPT = "_corrupt_record"


def kind_of(file_name) -> F.Column:
    """File name -> kind (first matching pattern), NULL for non-.jsonl files."""
    out = None
    for kind, pat in KIND_PATTERNS.items():
        cond = file_name.rlike(pat)
        out = F.when(cond, F.lit(kind)) if out is None else out.when(cond, F.lit(kind))
    return out


def _empty(spark: SparkSession, schema: T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)


def _missing(e: AnalysisException) -> bool:
    m = str(e)
    return "PATH_NOT_FOUND" in m or "Path does not exist" in m or "UNABLE_TO_INFER" in m


def scan_json(spark: SparkSession, path: str, schema: T.StructType,
              bad_lines: str = "permissive") -> DataFrame:
    """Read newline-delimited JSON with an explicit schema (no inference).

    A missing path gives an empty DataFrame of ``schema``. bad_lines:
    'permissive' (malformed fields NULL), 'failfast' (raise on the first bad
    line), 'quarantine' (adds ``_corrupt_record``; see ``split_quarantine``).
    """
    if bad_lines == "quarantine":
        schema = T.StructType(list(schema.fields) + [T.StructField(CORRUPT, T.StringType())])
        reader = (spark.read.schema(schema).option("mode", "PERMISSIVE")
                  .option("columnNameOfCorruptRecord", CORRUPT))
    elif bad_lines == "failfast":
        reader = spark.read.schema(schema).option("mode", "FAILFAST")
    elif bad_lines == "permissive":
        reader = spark.read.schema(schema)
    else:
        raise ValueError(f"unknown bad-line policy {bad_lines!r}")
    try:
        return reader.json(path)
    except AnalysisException as e:  # missing directory or no matching file
        if _missing(e):
            return _empty(spark, schema)
        raise


def scan_runs(spark: SparkSession, path: str, kind: str | None = "lifecycle",
              strict: bool = True, bad_lines: str = "permissive",
              with_file: bool = False, with_path: str | None = None) -> DataFrame:
    """Read ``path/*.jsonl`` with the kind's schema (all kinds merged by name
    when ``kind`` is None).

    strict: keep rows whose file routes to ``kind``; compat: keep every row of
    the glob, as a bare ``*.jsonl`` scan does. ``with_file`` adds the routed
    ``kind`` column; ``with_path`` names a column for the log file's path and reads log files
    only, no store.
    """
    schema = KIND_SCHEMAS[kind] if kind else merged_schema()
    cols = [f.name for f in schema.fields] + ([CORRUPT] if bad_lines == "quarantine" else []) \
        + (["kind"] if with_file else []) + ([with_path] if with_path else [])
    logs = _scan_logs(spark, path, kind, strict, bad_lines, schema, cols, with_path)
    if with_path or not is_store(spark, path):
        return logs
    stored = read_store(spark, path, kind if strict else None)
    if bad_lines == "quarantine":
        stored = stored.withColumn(CORRUPT, F.lit(None).cast("string"))
    return logs.unionByName(stored.select(*cols))


def _scan_logs(spark: SparkSession, path: str, kind: str | None, strict: bool, bad_lines: str,
               schema: T.StructType, cols: list[str], with_path: str | None = None) -> DataFrame:
    df = scan_json(spark, f"{path.rstrip('/')}/*.jsonl", schema, bad_lines)
    if not df.columns or "_metadata" not in _metadata_names(df):
        # empty stand-in for a missing path: no files, so no file names to route
        none = F.lit(None).cast("string")
        return df.withColumns({c: none for c in ("kind", with_path) if c}).select(*cols)
    routed = df.withColumn("kind", kind_of(F.col("_metadata.file_name")))
    if kind and strict:
        routed = routed.where(F.col("kind") == kind)
    if with_path:
        routed = routed.withColumn(with_path, F.col("_metadata.file_path"))
    return routed.select(*cols)


def _metadata_names(df: DataFrame) -> list[str]:
    try:
        df.select("_metadata.file_name").schema
        return ["_metadata"]
    except AnalysisException:
        return []


def split_quarantine(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good rows without the corrupt column, bad rows with every column) of a frame.

    Both are plain filters of ``df``: nothing is copied. The JSON reader refuses a query whose
    only needed column is the corrupt record (a ``count`` of either side would be one), so
    the filter also looks at another column. ``quarantine.ingest_logs`` stores both sides in
    the one pass that parses.
    """
    other = next(c for c in df.columns if c not in (CORRUPT, "kind"))
    # nothing of the other column enters the text
    text = F.concat_ws("", F.col(CORRUPT), F.substring(F.col(other).cast("string"), 1, 0))
    return df.where(F.length(text) == 0).drop(CORRUPT), df.where(F.length(text) > 0)


def parse_created_at(df: DataFrame, src: str = "created_at", out: str = "created_ts") -> DataFrame:
    """ISO-UTC text -> timestamp (independent of the session time zone)."""
    return df.withColumn(out, F.to_timestamp_ntz(F.col(src)))
