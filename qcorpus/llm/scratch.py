"""Intermediate tables in the shared checkpoint folder.

A written table cuts lineage: a lost executor costs the tasks that it ran,
not the steps before the table.  The folder is the one the cluster names in
``spark.checkpoint.dir`` (``qcorpus.session.checkpoint_dir``).
"""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from qcorpus.session import checkpoint_dir


def folder(spark: SparkSession, name: str) -> str:
    """A new path below the shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


BATCH_BYTES = 4 << 20
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


@contextmanager
def small_batches(spark: SparkSession):
    """Python workers get Arrow batches of at most ``BATCH_BYTES`` (or one row),
    whatever the rows hold; the session's own setting comes back after."""
    before = spark.conf.get(_BATCH_SETTING, None)
    spark.conf.set(_BATCH_SETTING, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.unset(_BATCH_SETTING) if before is None else spark.conf.set(_BATCH_SETTING, before)


def keep_batches_small(spark: SparkSession) -> None:
    """As ``small_batches``, from now on: for a DataFrame that is handed out and
    run by the caller.  A value that the session was given stays."""
    if _BATCH_SETTING not in spark.conf.getAll:
        spark.conf.set(_BATCH_SETTING, str(BATCH_BYTES))


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again."""
    spark = df.sparkSession
    path = folder(spark, name)
    with small_batches(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
