"""Session construction and the shared scratch folder.

On a cluster the shared folder is whatever ``spark.checkpoint.dir`` names; it
is read from the session and never replaced. Only for a local master, and only
when it is unset (tests, a laptop), do we create one.
"""

from __future__ import annotations

import atexit
import contextlib
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import SparkSession


def get_session(master: str | None = None, app: str = "runlens",
                shuffle_partitions: int | None = None,
                extra_conf: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the settings the library relies on.

    AQE stays on so joins against small aggregates become broadcasts at run
    time (a checked size, with sort-merge as the fallback) and skewed shuffle
    partitions are split. The shuffle partition count is set only when given
    (argument or ``RUNLENS_SHUFFLE_PARTITIONS``) or for a local master (8);
    under ``spark-submit`` the cluster's own setting stays in force.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    local = bool(master and master.startswith("local"))
    parts = shuffle_partitions or os.environ.get("RUNLENS_SHUFFLE_PARTITIONS") or (8 if local else None)
    if parts:
        b = b.config("spark.sql.shuffle.partitions", str(parts))
    b = (b.config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
         .config("spark.sql.adaptive.skewJoin.enabled", "true")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.sql.execution.arrow.pyspark.enabled", "true")
         # a checkpoint goes once nothing refers to it any more
         .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true"))
    for k, v in (extra_conf or {}).items():
        b = b.config(k, str(v))
    if local:
        b = b.config("spark.driver.memory", os.environ.get("RUNLENS_DRIVER_MEMORY", "16g"))
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Checkpoint folder shared by all executors.

    Reads ``spark.checkpoint.dir`` (or the context's checkpoint dir). Unset, it
    is an error unless the master is local, where every task sees the driver's
    disk and a temporary folder is created and registered.
    A Spark Connect session has no local context: the server checkpoints into
    its own configured folder, whose name is returned.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # Spark Connect: no SparkContext on the client
        d = spark.conf.get("spark.checkpoint.dir", None)
        if not d:
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on the server")
        return d
    d = sc.getCheckpointDir()
    if d:
        return d
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if conf_dir:
        sc.setCheckpointDir(conf_dir)
    elif is_local(sc.master):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="runlens-ckpt-"))
    else:
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return sc.getCheckpointDir()


def is_local(master: str) -> bool:
    """One JVM: ``local``, ``local[n]``; not ``local-cluster[...]``, whose executors are processes."""
    return master == "local" or master.startswith("local[")


def scratch_path(spark: SparkSession, name: str, keep: bool = False) -> str:
    """A fresh, unique path under the shared folder for an intermediate table,
    removed when the session's process ends unless ``keep``."""
    path = f"{shared_dir(spark).rstrip('/')}/runlens-{name}-{uuid.uuid4().hex}"
    if not keep:
        atexit.register(_remove_at_exit, spark, path)
    return path


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a folder through Hadoop's file systems (none there: nothing to do)."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def _remove_at_exit(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the JVM may be gone
        remove_path(spark, path)


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the executors' Python workers, once per context: they need
    no PYTHONPATH of their own."""
    sc = spark.sparkContext
    if getattr(sc, "_runlens_shipped", False):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="runlens-package-")
    path = os.path.join(folder, "runlens_package.zip")
    with zipfile.ZipFile(path, "w") as z:
        for top, _, names in os.walk(here):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(top, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(here)))
    sc.addPyFile(path)  # the driver's own file; Spark serves it to the executors
    sc._runlens_shipped = True


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path, or anything a glob names, exists in its file system."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = target.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(target)
    return found is not None and len(found) > 0
