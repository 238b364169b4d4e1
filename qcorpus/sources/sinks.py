"""Sinks (A7-A9, A12, A13): split writes, event logs, CSV tables, vector
collections and one-document summaries.  Writes go to directories (one file
per task), so every sink is parallel and restartable."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Preview lengths of the event log.
SQL_PREVIEW, QUESTION_PREVIEW, REASONING_PREVIEW = 200, 120, 200


def write_split(df: DataFrame, path: str, status_col: str = "status",
                valid_status: str = "validated") -> dict[str, int]:
    """Valid and rejected records as JSONL below ``split=valid`` and
    ``split=rejected`` of ``path`` (a folder without rows is not made, quirk
    Q10).  One write, so the input is computed once; both counts are observed
    during it."""
    from pyspark.sql import Observation
    ok = F.coalesce(F.col(status_col) == valid_status, F.lit(False))
    obs = Observation("split")
    out = df.withColumn("split", F.when(ok, "valid").otherwise("rejected")) \
            .observe(obs, F.count_if(ok).alias("valid"), F.count_if(~ok).alias("rejected"))
    out.write.mode("overwrite").partitionBy("split").json(path)
    m = obs.get
    return {"valid": m["valid"], "rejected": m["rejected"]}


def replace_folder(spark, new: str, path: str) -> None:
    """Put the written folder ``new`` in the place of ``path``: the old folder
    is moved aside first and deleted last, so at any moment one of the two is
    whole."""
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path
    fs = hadoop(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    old = hadoop(new + ".old")
    if fs.exists(hadoop(path)):
        fs.rename(hadoop(path), old)
    if not fs.rename(hadoop(new), hadoop(path)):
        fs.rename(old, hadoop(path))
        raise OSError(f"could not move {new} to {path}")
    fs.delete(old, True)


def to_events(df: DataFrame, event, ts_col: str | None = None) -> DataFrame:
    """Event rows (``event`` a name or a Column) with an ISO millisecond
    timestamp, previews cut to 200/120/200 characters and the reward
    rounded to 4."""
    cols = [(F.lit(event) if isinstance(event, str) else event).alias("event"),
            F.date_format(F.col(ts_col) if ts_col else F.current_timestamp(),
                          "yyyy-MM-dd'T'HH:mm:ss.SSS").alias("timestamp")]
    have = set(df.columns)
    for c in ("item_id", "question_id", "db_id", "target_difficulty", "actual_difficulty", "reject_reason",
              "attempt_number", "bucket_freq", "missing_buckets", "forbidden_found", "was_refined", "is_correct",
              "error", "detail"):
        if c in have:
            cols.append(F.col(c))
    if "reward" in have:
        cols.append(F.round("reward", 4).alias("reward"))
    if "sql" in have:
        cols.append(F.substring("sql", 1, SQL_PREVIEW).alias("sql_preview"))
    if "question" in have:
        cols.append(F.substring("question", 1, QUESTION_PREVIEW).alias("question_preview"))
    if "reasoning" in have:
        cols.append(F.substring("reasoning", 1, REASONING_PREVIEW).alias("reasoning_preview"))
    return df.select(*cols)


def append_events(events: DataFrame, log_dir: str) -> None:
    """Append to the event-log directory (new JSONL files per write)."""
    events.write.mode("append").json(log_dir)


def write_csv(df: DataFrame, path: str, sort_cols: list[str] | None = None) -> None:
    """A result table as CSV with header (sorted when asked)."""
    (df.orderBy(*sort_cols) if sort_cols else df).write.mode("overwrite").option("header", True).csv(path)


def write_vectors(vectors: DataFrame, path: str, id_col: str = "id") -> int:
    """A12 + D8: replace a vector collection; ids must be unique.  The new
    collection is written beside the old one and takes its place only after its
    ids and its stored count are verified."""
    import uuid
    new = f"{path.rstrip('/')}.new-{uuid.uuid4().hex}"
    stored = _write_verified(vectors, new, id_col)
    replace_folder(vectors.sparkSession, new, path)
    return stored


def _write_verified(vectors: DataFrame, new: str, id_col: str) -> int:
    """Write to the new folder ``new``; its count and unique ids are verified."""
    from pyspark.sql import Observation
    spark = vectors.sparkSession
    obs = Observation("vectors")
    vectors.observe(obs, F.count(F.lit(1)).alias("n")).write.parquet(new)
    expected = obs.get["n"]
    written = spark.read.parquet(new)
    stored = written.count()
    if stored != expected:
        raise ValueError(f"vector count mismatch: stored {stored}, expected {expected}")
    if written.groupBy(id_col).count().filter(F.col("count") > 1).limit(1).count():
        raise ValueError("duplicate vector ids")
    return stored


def _filesystem(spark, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return hadoop, hadoop(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def vector_versions(spark, path: str) -> list[int]:
    """The numbers of the collection's versions, in order."""
    hadoop, fs = _filesystem(spark, path)
    folder = hadoop(f"{path.rstrip('/')}/versions")
    if not fs.exists(folder):
        return []
    names = [f.getPath().getName() for f in fs.listStatus(folder) if f.getLen() > 0]
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))


def write_vector_version(vectors: DataFrame, path: str, id_col: str = "id") -> int:
    """A12 + D8: add a version to a collection and return its number.

    Data go to a folder of their own that is never changed; once its ids and count
    are verified, one small manifest is created that must not exist yet, so
    nothing is renamed (a copy on object stores), a failed write leaves no
    version and of two writers of one number the later takes the next.
    """
    import json
    import uuid

    from py4j.protocol import Py4JJavaError
    spark, base = vectors.sparkSession, path.rstrip("/")
    data = f"data-{uuid.uuid4().hex}"
    count = _write_verified(vectors, f"{base}/{data}", id_col)
    hadoop, fs = _filesystem(spark, path)
    number = max(vector_versions(spark, path), default=0) + 1
    while True:
        place = hadoop(f"{base}/versions/{number:010d}.json")
        try:
            out = fs.create(place, False)
        except Py4JJavaError:
            if not fs.exists(place):
                raise
            number += 1
            continue
        out.write(bytearray(json.dumps({"data": data, "count": count}).encode()))
        out.close()
        return number


def read_vector_version(spark, path: str, version: int | None = None) -> DataFrame:
    """The collection as of ``version`` (the latest by default); later
    writes do not change it."""
    import json
    base = path.rstrip("/")
    if version is None:
        found = vector_versions(spark, path)
        if not found:
            raise ValueError(f"no version in {path}")
        version = found[-1]
    spec = json.loads(spark.read.text(f"{base}/versions/{version:010d}.json", wholetext=True).first()["value"])
    return spark.read.parquet(f"{base}/{spec['data']}")


def write_registry(entries: DataFrame, path: str) -> None:
    """A10: replace the registry stored at ``path`` (JSONL), old until whole."""
    import uuid
    new = f"{path.rstrip('/')}.new-{uuid.uuid4().hex}"
    entries.write.json(new)
    replace_folder(entries.sparkSession, new, path)


def write_summary(summary: DataFrame, path: str) -> None:
    """A one-row summary as a single JSON document."""
    summary.coalesce(1).write.mode("overwrite").json(path)
