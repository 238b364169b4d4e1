"""Session helpers: a local session for tests/bench and a checkpoint folder
that honours ``spark.checkpoint.dir`` when the cluster sets it."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "qcorpus") -> SparkSession:
    """A local session for tests and the bench (UI off, AQE on, UTC)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("QCORPUS_DRIVER_MEMORY", "8g"))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by the cluster.

    ``spark.checkpoint.dir`` is read from the session.  Only a local-mode
    session without one (tests, the bench) gets a scratch folder; on a
    cluster a missing setting is an error, because a machine-local folder
    would not survive the loss of the executor that wrote it.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder (e.g. on HDFS or object storage)")
        configured = tempfile.mkdtemp(prefix="qcorpus-ckpt-")
    sc.setCheckpointDir(configured)
    return configured


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint folder (never local)."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def plan_bytes(df: DataFrame) -> int | None:
    """The optimizer's size estimate of ``df``; no job runs."""
    try:
        return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    except Exception:  # sessions without a JVM plan (Spark Connect)
        return None


SPREAD_BYTES = 1 << 30


def spread(df: DataFrame, min_partitions: int | None = None) -> DataFrame:
    """Spread a small input over the cluster before CPU-heavy per-row work.

    A small table stored as one parquet row group scans as a single task, so
    regex scoring or text extraction would run on one core.  An input whose
    estimated size is below 1 GiB and whose scan has fewer partitions than the
    cluster's parallelism is repartitioned round-robin; a larger one keeps its
    own splits, whatever their number, so its rows are not shuffled."""
    size = plan_bytes(df)
    if size is None or size > SPREAD_BYTES:
        return df
    target = min_partitions or df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= target else df.repartition(target)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one of the given parquet tables."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


MAX_BROADCAST_BYTES = 64 << 20


def broadcast_if_small(df: DataFrame, max_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """``broadcast(df)`` where the optimizer's estimate of its size is at most
    ``max_bytes``; else ``df`` as it is, joined by shuffle (or broadcast by AQE
    once its measured size allows).  No job runs."""
    from pyspark.sql import functions as F
    size = plan_bytes(df)
    return F.broadcast(df) if size is not None and size <= max_bytes else df
