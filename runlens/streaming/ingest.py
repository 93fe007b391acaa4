"""Incremental ingestion of run logs.

Collectors append NDJSON files to a results folder; the batch reports re-read
the whole folder. At scale the same scan runs as a streaming file source: each
trigger picks up only files not yet seen (tracked in the checkpoint), routes
their rows to a kind by file name and commits them to the run store's log (the one
that batch writers use), which the batch reports then read with partition pruning.
Restarting from the checkpoint resumes without duplicating rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from runlens.session import scratch_path
from runlens.sources.runlogs import kind_of
from runlens.sources.schemas import KIND_SCHEMAS, merged_schema
from runlens.sources.sinks import append_runs


def stream_runs(spark: SparkSession, path: str, kind: str | None = None,
                max_files_per_trigger: int | None = None) -> DataFrame:
    """Streaming scan of ``path/*.jsonl`` with an explicit schema and a ``kind``
    column from the file name (rows of other kinds dropped when ``kind`` is set)."""
    schema = KIND_SCHEMAS[kind] if kind else merged_schema()
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    df = reader.json(f"{path.rstrip('/')}/*.jsonl")
    routed = df.withColumn("kind", kind_of(F.col("_metadata.file_name")))
    if kind:
        routed = routed.where(F.col("kind") == kind)
    return routed


def ingest_runs(runs: DataFrame, out: str, checkpoint: str | None = None,
                available_now: bool = True) -> StreamingQuery:
    """Append the stream to the run store at ``out``, a commit per trigger.

    ``checkpoint`` defaults to a fresh folder under the shared checkpoint
    directory; pass the same path again to resume. A trigger that is run again after a
    failure has the same batch id, so its rows are in the store once.
    ``available_now`` processes what is there and stops; otherwise the query keeps polling.
    """
    ckpt = checkpoint or scratch_path(runs.sparkSession, "ingest-ckpt", keep=True)

    def store(rows: DataFrame, trigger: int) -> None:
        append_runs(rows, out, batch_id=f"{ckpt}#{trigger}")

    w = runs.writeStream.foreachBatch(store).outputMode("append").option("checkpointLocation", ckpt)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()
