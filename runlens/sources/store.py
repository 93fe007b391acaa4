"""The run store: batches of Parquet files behind one commit log.

::

    store/_log/00000000000000000003.json     one entry per version
    store/batch=<id>/kind=<kind>/provider=<provider>/part-*.parquet

A writer puts its rows into a new batch folder, then publishes them in one step:
it renames a finished log entry to the next version's name, which fails if another
writer was first (then the next version is tried). Readers list the log and read only
the batches it names, so a half-written batch is never seen and a failed write
leaves everything as it was. Nothing is deleted by a write: a replaced slice is hidden
by its entry, which also lets a frame read from a slice replace that slice, and
``vacuum`` removes what no reader can reach any more.

An entry may carry a batch id of the caller's choosing. A second commit with the same id
adds nothing, so a retried append or a replayed streaming batch is there once.

Records are stored with the kinds' own types and read with an explicit schema: no
footer is opened to find one, and keys stay text (``007`` is not 7). Kind and provider
are partition columns; a null provider has Spark's null folder, and the empty text and the
names that would be mistaken for it are escaped (``_empty_`` before the name).

A folder partitioned by kind and provider that has no log is read as it is; once a log stands
beside them, its rows count as older than every entry.

Lines that are no records may be committed with the rows (``quarantine.py``): the kind
``BAD_KIND`` holds them, ``read_bad`` reads them, and every other read leaves them out.
"""

from __future__ import annotations

import json
import re
import uuid
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runlens.session import path_exists, remove_path
from runlens.sources.schemas import KIND_SCHEMAS, merged_schema

STORE_KEYS = ["kind", "provider"]
_NULL, _MARK = "__HIVE_DEFAULT_PARTITION__", "_empty_"
_LOG = "_log"
BAD_KIND = "_quarantine"
BAD_FILE, BAD_LINE, BAD_REASON = "_bad_file", "_bad_line", "_bad_reason"
_BAD_FIELDS = [T.StructField(c, T.StringType()) for c in (BAD_FILE, BAD_LINE, BAD_REASON)]
_ENTRY = T.StructType([
    T.StructField("version", T.LongType()), T.StructField("batch", T.StringType()),
    T.StructField("batch_id", T.StringType()), T.StructField("everything", T.BooleanType()),
    T.StructField("slices", T.ArrayType(T.ArrayType(T.StringType())))])

Slice = tuple[str | None, str | None]


def _escaped(c: Column) -> Column:
    odd = (c == "") | (c == _NULL) | c.startswith(_MARK)
    return F.when(odd, F.concat(F.lit(_MARK), c)).otherwise(c)


def _plain(c: Column) -> Column:
    return F.when(c.startswith(_MARK), c.substr(F.lit(len(_MARK) + 1), F.length(c))).otherwise(c)


def _stored_fields() -> list[T.StructField]:
    return [f for f in merged_schema().fields if f.name not in STORE_KEYS] + _BAD_FIELDS


def entries(spark: SparkSession, path: str) -> list:
    """The log's entries in version order: one row per write since the store began."""
    if not path_exists(spark, f"{path}/{_LOG}/*.json"):
        return []
    return spark.read.schema(_ENTRY).json(f"{path}/{_LOG}/*.json").orderBy("version").collect()


def is_store(spark: SparkSession, path: str) -> bool:
    return path_exists(spark, f"{path.rstrip('/')}/{_LOG}")


def version(spark: SparkSession, path: str) -> int:
    """The last published version, 0 for none."""
    known = entries(spark, path.rstrip("/"))
    return known[-1].version if known else 0


def _publish(spark: SparkSession, path: str, entry: dict, at: int | None = None) -> bool:
    """Appends an entry to the log; False if its batch id is there already, or the log is
    past the version ``at``."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    conf = spark._jsc.hadoopConfiguration()
    log = hadoop.Path(f"{path}/{_LOG}")
    fs = log.getFileSystem(conf)
    log = fs.makeQualified(log)
    fs.mkdirs(log)
    context = hadoop.FileContext.getFileContext(log.toUri(), conf)
    never = spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 1)
    never[0] = hadoop.Options.Rename.NONE
    while True:
        known = entries(spark, path)
        if any(e.batch_id == entry["batch_id"] for e in known):
            return False
        last = known[-1].version if known else 0
        if at is not None and last != at:
            return False
        part = hadoop.Path(log, f".{uuid.uuid4().hex}.tmp")
        out = fs.create(part, False)
        out.write(bytearray(json.dumps({"version": last + 1, **entry}).encode()))
        out.close()
        target = hadoop.Path(log, f"{last + 1:020d}.json")
        try:
            context.rename(part, target, never)
            return True
        except Exception:  # another writer took this version
            fs.delete(part, False)
            if not fs.exists(target):
                raise


def commit(rows: DataFrame, path: str, batch_id: str | None = None, everything: bool = False,
           slices: list[Slice] | None = None, at: int | None = None) -> bool:
    """Writes ``rows`` (with ``kind``) as one batch and publishes it, hiding the older rows
    of the named slices or ``everything``. False if ``batch_id`` was committed before, or if
    anything was published after the version ``at``.
    """
    path, spark = path.rstrip("/"), rows.sparkSession
    if batch_id is not None and any(e.batch_id == batch_id for e in entries(spark, path)):
        return False
    batch = uuid.uuid4().hex
    have = rows.columns
    typed = [(F.col(f.name).cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType)).alias(f.name)
             for f in _stored_fields()]
    keys = [_escaped(F.col(k).cast("string")).alias(k) for k in STORE_KEYS]
    rows.select(*typed, *keys).write.partitionBy(*STORE_KEYS).parquet(f"{path}/batch={batch}")
    entry = {"batch": batch, "batch_id": batch_id or batch, "everything": everything,
             "slices": [list(s) for s in slices or []]}
    return _publish(spark, path, entry, at)


def _live(log: list) -> tuple[dict[str, int], dict[Slice, int]]:
    """(version of each batch since everything was last replaced, version that last replaced each slice)."""
    start = max((i for i, e in enumerate(log) if e.everything), default=0)
    hidden: dict[Slice, int] = {}
    for e in log[start:]:
        for s in e.slices:
            hidden[tuple(s)] = e.version
    return {e.batch: e.version for e in log[start:]}, hidden


def _map(items: dict, key_type: str) -> Column:
    pairs = [F.lit(x) for kv in items.items() for x in kv]
    return F.create_map(*pairs) if pairs else F.create_map().cast(f"map<{key_type},bigint>")


def _folders(spark: SparkSession, path: str, paths: list[str], keys: list[str]) -> DataFrame:
    """Parquet folders of the stored fields, partitioned by ``keys``."""
    schema = T.StructType([*_stored_fields(), *(T.StructField(c, T.StringType()) for c in keys)])
    try:
        return (spark.read.schema(schema).option("basePath", path).parquet(*paths)
                if paths else spark.createDataFrame([], schema))
    except AnalysisException as e:  # only empty batches
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def _published(spark: SparkSession, path: str) -> DataFrame:
    """Every row that the log shows, by all stored fields, provider and kind."""
    log = entries(spark, path)
    batches, hidden = _live(log)
    df = None
    if not any(e.everything for e in log) and path_exists(spark, f"{path}/kind=*"):
        # written before there was a log: older than any version
        df = _folders(spark, path, [path] if not log else [f"{path}/kind=*"], STORE_KEYS).withColumn("batch", F.lit(""))
    if batches or df is None:
        logged = _folders(spark, path, [f"{path}/batch={b}" for b in batches], ["batch", *STORE_KEYS])
        df = logged if df is None else df.unionByName(logged)
    batches[""] = 0
    provider = _plain(F.col("provider"))
    if hidden:
        gone = [F.col("kind").eqNullSafe(F.lit(k)) & provider.eqNullSafe(F.lit(p))
                & (F.try_element_at(_map(batches, "string"), F.col("batch")) < F.lit(v)) for (k, p), v in hidden.items()]
        df = df.where(~reduce(Column.__or__, gone))
    return df


def read_store(spark: SparkSession, path: str, kind: str | None = None,
               providers: list[str] | None = None) -> DataFrame:
    """The store's published rows: fields of ``kind`` (all kinds' without one), provider and kind.

    Predicates on kind and provider, and the log's own, are partition filters: only matching
    folders are read. A store without entries, or none at all, has no rows. Quarantined lines
    are no rows.
    """
    schema = merged_schema() if kind is None else KIND_SCHEMAS[kind]
    names = [f.name for f in schema.fields if f.name not in STORE_KEYS]
    df, provider = _published(spark, path.rstrip("/")), _plain(F.col("provider"))
    df = df.where(~F.col("kind").eqNullSafe(F.lit(BAD_KIND)) if kind is None else F.col("kind") == kind)
    if providers is not None:
        df = df.where(provider.isin(providers))
    return df.select(*names, provider.alias("provider"), _plain(F.col("kind")).alias("kind"))


def read_bad(spark: SparkSession, path: str) -> DataFrame:
    """The quarantined lines: file, line, reason, and the kind of their file as ``provider``."""
    df = _published(spark, path.rstrip("/")).where(F.col("kind") == BAD_KIND)
    return df.select(BAD_FILE, BAD_LINE, BAD_REASON, _plain(F.col("provider")).alias("provider"))


def vacuum(spark: SparkSession, path: str, grace_s: float = 86_400) -> list[str]:
    """Removes batches that no reader reaches: those older than the last replacement of
    everything, and unpublished ones untouched for ``grace_s`` seconds (a writer may still be at work
    on a younger one). Returns their ids."""
    path = path.rstrip("/")
    hadoop = spark._jvm.org.apache.hadoop.fs
    root = hadoop.Path(path)
    found = root.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(hadoop.Path(f"{path}/batch=*")) or []
    log = entries(spark, path)
    live, known = _live(log)[0], {e.batch for e in log}
    now = spark._jvm.java.lang.System.currentTimeMillis()
    out = []
    for status in found:
        batch = re.sub("^batch=", "", status.getPath().getName())
        if batch not in live and (batch in known or now - status.getModificationTime() > grace_s * 1000):
            remove_path(spark, status.getPath().toString())
            out.append(batch)
    return out
