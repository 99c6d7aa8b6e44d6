"""Session construction and checkpoint-directory handling."""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import SparkSession
from pyspark.sql import types as T


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "encore", extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the settings the operators assume.

    AQE is on so joins against small runtime-sized sides become broadcast
    joins only after the size is measured, skewed shuffle partitions are
    split, and small partitions are coalesced.
    """
    cpus = os.environ.get("BENCH_CPUS", "8")
    master = master or f"local[{cpus}]"
    parts = shuffle_partitions or max(8, 2 * int(cpus))
    b = (SparkSession.builder.master(master).appName(app_name)
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.sql.shuffle.partitions", str(parts))
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
         .config("spark.sql.adaptive.skewJoin.enabled", "true")
         .config("spark.sql.session.timeZone", "UTC")
         # checkpoint files are deleted once their relation is unreferenced
         .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
         .config("spark.driver.memory", os.environ.get("ENCORE_DRIVER_MEMORY", "16g")))
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint directory, setting one only if unset.

    The cluster names its shared folder in ``spark.checkpoint.dir``; that
    is always used.  Only a local-mode session (tests) without one gets a
    fresh private folder; on a cluster a missing setting is an error,
    because a machine-local folder does not survive executor loss.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - Spark Connect: the server owns the folder
        return spark.conf.get("spark.checkpoint.dir", None)
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = sc.getConf().get("spark.checkpoint.dir", None)
    if conf_dir:
        sc.setCheckpointDir(conf_dir)
        return sc.getCheckpointDir()
    if sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="encore-ckpt-"))
        return sc.getCheckpointDir()
    raise RuntimeError("spark.checkpoint.dir is not set; configure a shared folder")


#: Spark's switch for removing an action's shuffle files when it has ended.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_removed(spark: SparkSession):
    """Actions on DataFrames that are made inside leave no shuffle files: they go, on all
    executors, when the action has ended and not when the driver's garbage happens to be
    collected.  For results that are written and read back from there."""
    was = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        if was is None:
            spark.conf.unset(SHUFFLE_CLEANUP)
        else:
            spark.conf.set(SHUFFLE_CLEANUP, was)


def materialise(df, name: str = "stage"):
    """Cut lineage with a reliable, eager checkpoint in the shared folder.

    The plan runs once (the eager checkpoint writes while computing), the
    copy survives executor loss, and the checkpointed relation keeps its
    output partitioning so downstream operators on the same keys do not
    shuffle again.  Its shuffle files go when it is written.  ``name`` only documents the
    call site.
    """
    ensure_checkpoint_dir(df.sparkSession)
    with shuffles_removed(df.sparkSession):
        return df.select("*").checkpoint(eager=True)  # a new frame: the switch is read when it is made


def stored(df, name: str = "stage"):
    """Write ``df`` once as Parquet in the shared folder and read it back: columns are
    compressed and a later use reads only its own, where a checkpoint holds whole
    rows.  Its shuffle files go when it is written.  Partitioning and order are not kept.  What Parquet cannot hold (two columns of
    one name, columns without a type) is checkpointed."""
    root = ensure_checkpoint_dir(df.sparkSession)
    names = [f.name.lower() for f in df.schema.fields]
    if not root or len(set(names)) < len(names) or any(isinstance(f.dataType, T.NullType) for f in df.schema.fields):
        return materialise(df, name)
    path = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    with shuffles_removed(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
