"""Record sources (A1, A2, A6, A10, A11): JSON arrays, JSONL, manifests,
registries and resume."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed schema of a corpus record (nullable fields added by later steps).
CORPUS_SCHEMA = (
    "question_id BIGINT, db_id STRING, question STRING, sql STRING, evidence STRING, reward DOUBLE, "
    "bucket_freq MAP<STRING,BIGINT>, buckets_present ARRAY<STRING>, difficulty STRING, "
    "target_difficulty STRING, was_refined BOOLEAN, status STRING, "
    "metadata STRUCT<tables: ARRAY<STRING>, gen_attempts: INT, gen_timestamp: TIMESTAMP>, "
    "execution_time DOUBLE, validation_error STRING, "
    "error_detail STRUCT<type: STRING, sqlstate: STRING, message: STRING>, "
    "validation_result STRUCT<is_correct: BOOLEAN, reasoning: STRING, sql_output: ARRAY<STRING>, judge_error: STRING>, "
    "validation_timestamp TIMESTAMP"
)


def read_records(spark: SparkSession, path: str, schema: str = CORPUS_SCHEMA) -> DataFrame:
    """A1: a file holding one JSON array of records (multi-line JSON)."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_jsonl(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A2: JSON Lines, one record per line (splittable: one task per block)."""
    r = spark.read
    if schema:
        r = r.schema(schema)
    return r.json(path)


def load_manifest(spark: SparkSession, manifest_path: str, readers: dict | None = None) -> dict[str, DataFrame | str]:
    """A JSON manifest, in any store that Spark reads, whose values are paths
    relative to it; each entry becomes a lazy DataFrame (``readers[name](spark, path)``, JSON by
    default) or, for directories, the resolved path."""
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path
    place = hadoop(manifest_path)
    fs = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    spec = json.loads(spark.read.text(manifest_path, wholetext=True).first()["value"])
    base = fs.makeQualified(place).getParent()
    out = {}
    for name, rel in spec.items():
        target = hadoop(base, rel)
        path = target.toString()
        if readers and name in readers:
            out[name] = readers[name](spark, path)
        elif path.endswith(".jsonl"):
            out[name] = read_jsonl(spark, path)
        elif fs.getFileStatus(target).isDirectory():
            out[name] = path
        else:
            out[name] = spark.read.option("multiLine", True).json(path)
    return out


HASHES = 5
MAX_FILTER_BITS = 1 << 28  # 32 MB


def _filter_places(keys: list[str], bits: int) -> list:
    """Places of a key in a Bloom filter of ``bits`` (a power of two)."""
    start = F.xxhash64(*keys).bitwiseAND(F.lit(bits - 1))
    step = F.xxhash64(F.lit(1), *keys).bitwiseAND(F.lit(bits - 1))
    return [(start + n * step + n * n).bitwiseAND(F.lit(bits - 1)) for n in range(HASHES)]


def key_filter(done: DataFrame, keys: list[str], bits: int) -> DataFrame:
    """One row, ``words``: the Bloom filter of the keys as ``bits`` / 64 numbers.

    Bits of a word merge by ``bit_or`` before the shuffle; the gathered row
    has the size of the filter, whatever the number of keys."""
    place = F.col("place")
    one = F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(F.lit(63)).cast("int"))
    set_bits = done.select(F.explode(F.array(*_filter_places(keys, bits))).alias("place")).select(
        F.shiftright(place, 6).alias("word"), one.alias("set"))
    empty = done.sparkSession.range(bits // 64).select(F.col("id").alias("word"), F.lit(0).cast("long").alias("set"))
    words = set_bits.unionByName(empty).groupBy("word").agg(F.bit_or("set").alias("set"))
    return words.agg(F.transform(F.array_sort(F.collect_list(F.struct("word", "set"))), lambda w: w["set"]).alias("words"))


def pending(items: DataFrame, done: DataFrame, key: str | list[str], retry_failed: bool = False,
            failed_col: str = "failed", expected: int = 1_000_000) -> DataFrame:
    """Items whose key is not in the output yet; with ``retry_failed``
    failed outputs count as not done (quirk Q11).

    A Bloom filter of the done keys, sized for ``expected`` of them (ten bits
    each, 32 MB at most), passes items that cannot be done without a shuffle;
    only the others meet the done keys in an exact anti join.  A filter too
    small for the output prunes less and changes no row.  Keys of other types
    than text, whole numbers and dates, and keys whose type differs between the
    two tables, go through the anti join alone.  A null key is never done.
    ``items`` is read twice and must give the same rows both times."""
    d = done.filter(~F.coalesce(F.col(failed_col), F.lit(False))) if retry_failed and failed_col in done.columns else done
    keys = [key] if isinstance(key, str) else key
    d = d.select(*keys)
    kinds = [items.schema[k].dataType for k in keys]
    plain = ("string", "tinyint", "smallint", "int", "bigint", "date", "timestamp")
    if kinds != [d.schema[k].dataType for k in keys] or any(k.simpleString() not in plain for k in kinds):
        return items.join(d, keys, "left_anti")
    bits = min(MAX_FILTER_BITS, 1 << max(16, (10 * expected - 1).bit_length()))
    words = key_filter(d, keys, bits).scalar()
    found = F.lit(True)
    for place in _filter_places(keys, bits):
        word = F.get(words, F.shiftright(place, 6).cast("int"))
        found = found & (F.getbit(word, place.bitwiseAND(F.lit(63)).cast("int")) == 1)
    return items.where(found).join(d, keys, "left_anti").unionByName(items.where(~found))


def upsert_registry(existing: DataFrame, new: DataFrame, key: str = "name") -> DataFrame:
    """A10: registry entries keyed by name; a new entry replaces the old
    one, the others stay."""
    return existing.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)
