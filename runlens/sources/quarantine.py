"""Ingestion with quarantine: bad log lines are kept beside the rows they came with.

``ingest_logs`` parses a results folder once and commits one batch to the run store: good
rows under their kind and provider, lines that are no record of the schema under the kind
``_quarantine`` (their file's kind as provider) with file, line and reason. Both are in one
write and one log entry, so a retried or failed ingestion can't give one without the other,
and no good row is copied to find the bad ones.

``replay`` parses the quarantined lines again, after a repair, and publishes what is now
readable together with what is still bad as the new content of the quarantine, in one log
entry made against the version that it read. A line is therefore either in quarantine or
among the rows, once, whatever else is committed meanwhile or tried again.

Null, empty and blank lines are no records and aren't kept; a missing folder ingests nothing;
lines of files that route to no kind are left out, as in the scans.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runlens.sources.runlogs import CORRUPT, scan_runs
from runlens.sources.schemas import merged_schema
from runlens.sources.store import BAD_FILE, BAD_KIND, BAD_LINE, BAD_REASON, commit, read_bad, version

# Reasons.
NOT_JSON, NOT_RECORD, WRONG_TYPE = "not json", "not a record", "wrong type"
_PARSED = "_rl_parsed"


def reason(line: Column) -> Column:
    """Why a line is no record: no JSON, JSON but no object, or a field of another type."""
    parsed = F.try_parse_json(line)
    return (F.when(parsed.isNull(), F.lit(NOT_JSON))
            .when(~F.schema_of_variant(parsed).startswith("OBJECT"), F.lit(NOT_RECORD))
            .otherwise(F.lit(WRONG_TYPE)))


def _routed(parsed: DataFrame) -> DataFrame:
    """Parsed lines (fields, ``kind``, file, text of bad ones) as the store's rows: bad lines
    leave their fields and go to the quarantine."""
    bad = F.col(CORRUPT).isNotNull()
    fields = [F.when(~bad, F.col(f.name)).alias(f.name) for f in merged_schema().fields if f.name not in ("kind", "provider")]
    return parsed.select(
        *fields, F.when(bad, F.col("kind")).otherwise(F.col("provider")).alias("provider"),
        F.when(bad, F.lit(BAD_KIND)).otherwise(F.col("kind")).alias("kind"),
        F.when(bad, F.col(BAD_FILE)).alias(BAD_FILE), F.col(CORRUPT).alias(BAD_LINE),
        F.when(bad, reason(F.col(CORRUPT))).alias(BAD_REASON))


def ingest_logs(spark: SparkSession, logs: str, store: str, batch_id: str | None = None) -> bool:
    """Add a results folder's log files to the store, bad lines to its quarantine, in one pass
    and one commit. False if ``batch_id`` was committed before."""
    rows = scan_runs(spark, logs, None, bad_lines="quarantine", with_file=True, with_path=BAD_FILE)
    return commit(_routed(rows.where(F.col("kind").isNotNull())), store, batch_id)


def quarantined(spark: SparkSession, store: str) -> DataFrame:
    """The lines in quarantine: kind, file, line, reason."""
    return read_bad(spark, store).select(F.col("provider").alias("kind"), F.col(BAD_FILE).alias("file"),
                                         F.col(BAD_LINE).alias("line"), F.col(BAD_REASON).alias("reason"))


def replay(spark: SparkSession, store: str, repair: Callable[[Column], Column] = lambda line: line,
           kinds: list[str] | None = None, tries: int = 10) -> int:
    """Parse the quarantined lines (of ``kinds``) again, ``repair`` applied to their text.

    Lines that are records now join the rows; the others stay in quarantine as they were.
    Another writer's commit in between makes it start over, ``tries`` times at most. Returns
    the number of lines taken out of quarantine.
    """
    for _ in range(tries):
        at = version(spark, store)
        bad = read_bad(spark, store)
        if kinds is not None:
            bad = bad.where(F.col("provider").isin(kinds))
        slices = [(BAD_KIND, r["provider"]) for r in bad.select("provider").distinct().collect()]  # a row per kind
        if not slices:
            return 0
        schema = T.StructType([*merged_schema().fields, T.StructField(CORRUPT, T.StringType())])
        options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
        text = repair(F.col(BAD_LINE))
        lines = bad.select(F.col("provider").alias("_rl_kind"), BAD_FILE, BAD_LINE, BAD_REASON,
                           F.from_json(text, schema, options).alias(_PARSED))
        still = F.col(_PARSED).isNull() | F.col(f"{_PARSED}.{CORRUPT}").isNotNull()
        names = [f.name for f in schema.fields if f.name not in ("kind", CORRUPT)]
        parsed = lines.select(*[F.col(f"{_PARSED}.{n}").alias(n) for n in names], F.col("_rl_kind").alias("kind"),
                              BAD_FILE, F.when(still, F.col(BAD_LINE)).alias(CORRUPT))
        freed = lines.agg(F.count_if(~still).alias("n")).first()["n"]
        if not freed:
            return 0
        if commit(_routed(parsed), store, slices=slices, at=at):
            return freed
    raise RuntimeError(f"{store}: other writers came first {tries} times")
