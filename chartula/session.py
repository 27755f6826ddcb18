"""Session helpers."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app_name: str = "chartula", **conf: str) -> SparkSession:
    """A session with the settings the jobs are written for; ``conf`` keys use ``__`` for ``.``."""
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Point the context at ``spark.checkpoint.dir``.

    A local session without the setting gets a temporary folder; on a cluster a missing
    setting is an error, because lineage must be cut into storage every executor shares.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        context.setCheckpointDir(configured)
    elif context.master.startswith("local"):
        context.setCheckpointDir(tempfile.mkdtemp(prefix="chartula-checkpoint-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")


def shared_path(spark: SparkSession, tag: str) -> str:
    """A new path below the checkpoint folder, which every executor can reach."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{tag}_{uuid.uuid4().hex}"


def bucketed(df: DataFrame, keys: list[str], tag: str) -> str:
    """Store ``df`` in the shared folder, bucketed by ``keys``, and return the name of its table.

    Joins on these keys need no exchange of it, in this and any later plan.  Drop the table when it is done with.
    """
    buckets = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    path = shared_path(df.sparkSession, tag)
    name = path.rpartition("/")[2]
    df.repartition(buckets, *keys).write.bucketBy(buckets, *keys).option("path", path).saveAsTable(name)
    return name


def append_bucketed(df: DataFrame, keys: list[str], name: str) -> None:
    """Add rows to a table made by ``bucketed``."""
    buckets = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    df.repartition(buckets, *keys).write.bucketBy(buckets, *keys).mode("append").saveAsTable(name)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
