"""A1 at scale: JSON arrays of records read by byte ranges.

A file that is one JSON array can be far larger than a task, and a range of it says
nothing about where it begins: outside a string, inside one, or behind a
backslash.  Two passes settle that:

1. every range is scanned once for each of the three possibilities, giving the
   state at its end and by how much it changes the depth; a fold over the ranges of
   a file (some numbers per range) gives the true state at each range's start;
2. every range is scanned from its true state.  An element begins at a ``[`` or
   ``,`` at the array's depth and belongs to the range that holds this byte; the
   task reads on behind its range until its last element ends.

So each element is read once whatever the ranges are, and a task holds one
buffer and one element.  A file may hold several arrays one after another.  Elements
become rows by ``from_json``; one that does not fit the schema gives null fields.

Files are listed by Spark and opened through ``pyarrow.fs`` by URI on the
executors, as Spark has no source that reads byte ranges of such files.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from qcorpus.session import checkpoint_dir

RANGE_BYTES = 64 << 20
BUFFER_BYTES = 1 << 20
OUTSIDE, INSIDE, ESCAPED = range(3)  # of a string; behind a backslash inside one
_OPEN, _CLOSE = (ord("["), ord("{")), (ord("]"), ord("}"))


def scan(data: bytes, state: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(places of brackets and commas outside strings, depth change at each,
    state at the end) of ``data`` begun in ``state``."""
    b = np.frombuffer(data, np.uint8)
    n = len(b)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), state
    place = np.arange(n)
    plain = b != ord("\\")
    last_plain = np.maximum.accumulate(np.where(plain, place, -1))
    before = np.r_[-1, last_plain[:-1]]
    run = place - 1 - before  # backslashes right before each byte
    run[before < 0] += state == ESCAPED
    escaped = run % 2 == 1
    quotes = (b == ord('"')) & ~escaped
    inside = (np.cumsum(quotes) + (state != OUTSIDE)) % 2 == 1  # behind each byte
    change = np.isin(b, _OPEN).astype(np.int64) - np.isin(b, _CLOSE)
    at = np.flatnonzero(((change != 0) | (b == ord(","))) & ~inside & ~quotes)
    end = INSIDE if inside[-1] else OUTSIDE
    if end == INSIDE and not plain[-1] and (run[-1] + 1) % 2 == 1:
        end = ESCAPED
    return at, change[at], end


def open_store(uri: str):
    """(file system, path) of a URI, a path, or Hadoop's form file:/path."""
    from pyarrow import fs
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return fs.FileSystem.from_uri(uri)


def _buffers(uri: str, start: int, stop: int | None) -> Iterator[bytes]:
    store, path = open_store(uri)
    with store.open_input_file(path) as f:
        size = f.size()
        stop = size if stop is None else min(stop, size)
        while start < stop:
            data = f.read_at(min(BUFFER_BYTES, stop - start), start)
            yield data
            start += len(data)


def summary(uri: str, start: int, stop: int) -> tuple[list[int], list[int]]:
    """Per state at the start: state at the end and depth change."""
    ends, changes = [OUTSIDE, INSIDE, ESCAPED], [0, 0, 0]
    for data in _buffers(uri, start, stop):
        for k in range(3):
            _, change, ends[k] = scan(data, ends[k])
            changes[k] += int(change.sum())
    return ends, changes


def elements(uri: str, start: int, stop: int, state: int, depth: int) -> Iterator[bytes]:
    """The elements that begin in a range, from the state and depth at its start."""
    place, piece, open_ = start, [], False
    for data in _buffers(uri, start, None):
        if place >= stop and not open_:
            return
        at, change, state = scan(data, state)
        levels = depth + np.cumsum(change)
        depth = int(levels[-1]) if len(levels) else depth
        bound = ((change > 0) & (levels == 1)) | ((change == 0) & (levels == 1)) | ((change < 0) & (levels == 0))
        done = 0
        for p, begins in zip(at[bound].tolist(), (change[bound] >= 0).tolist()):
            if open_:
                piece.append(data[done:p])
                yield b"".join(piece)
            piece, done = [], p + 1
            open_ = begins and place + p < stop
            if not open_ and place + p >= stop:
                return
        if open_:
            piece.append(data[done:])
        place += len(data)
    if open_:
        raise ValueError(f"{uri}: the array is cut off")


def read_json_array(spark: SparkSession, path: str, schema: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Rows of ``schema`` from the JSON arrays in the files of ``path``, any number
    of tasks a file.  Empty files and empty arrays give no rows; a file that ends
    inside an element raises."""
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("uri"), F.col("length").alias("size"))
    ranges = files.where("size > 0").select("uri", "size", F.explode(F.sequence(
        F.lit(0), F.floor((F.col("size") - 1) / range_bytes))).alias("part"))
    ranges = ranges.select("uri", "part", (F.col("part") * range_bytes).alias("start"),
                           F.least("size", (F.col("part") + 1) * range_bytes).alias("stop"))
    tasks = 4 * spark.sparkContext.defaultParallelism

    @F.arrow_udf("struct<ends: array<int>, changes: array<bigint>>")
    def summaries(uris: pa.Array, starts: pa.Array, stops: pa.Array) -> pa.Array:
        found = [summary(*r) for r in zip(uris.to_pylist(), starts.to_pylist(), stops.to_pylist())]
        return pa.StructArray.from_arrays([pa.array([f[0] for f in found], pa.list_(pa.int32())),
                                           pa.array([f[1] for f in found], pa.list_(pa.int64()))], ["ends", "changes"])

    @F.arrow_udf("array<struct<state: int, depth: bigint>>")
    def fold(chains: pa.Array) -> pa.Array:
        out = []
        for chain in chains:
            state, depth, mine = OUTSIDE, 0, []
            for one in chain.as_py():
                mine.append({"state": state, "depth": depth})
                state, depth = one["ends"][state], depth + one["changes"][state]
            out.append(mine)
        return pa.array(out, pa.list_(pa.struct([("state", pa.int32()), ("depth", pa.int64())])))

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                held, size = [], 0
                for one in elements(r["uri"], r["start"], r["stop"], r["state"], r["depth"]):
                    if one.strip():
                        held.append(one.decode())
                        size += len(one)
                    if size > BUFFER_BYTES:
                        yield pa.RecordBatch.from_pydict({"value": pa.array(held, pa.string())})
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_pydict({"value": pa.array(held, pa.string())})

    known = ranges.repartition(tasks, "uri", "part").withColumn("s", summaries("uri", "start", "stop"))
    chains = known.groupBy("uri").agg(F.array_sort(F.collect_list(F.struct("part", "start", "stop", "s"))).alias("chain"))
    states = chains.select("uri", "chain", fold(F.transform("chain", lambda c: c["s"])).alias("states"))
    placed = states.select("uri", F.explode(F.arrays_zip("chain", "states")).alias("x")).select(
        "uri", "x.chain.start", "x.chain.stop", "x.states.state", "x.states.depth")
    found = f"{checkpoint_dir(spark).rstrip('/')}/ranges-{uuid.uuid4().hex}"
    placed.write.parquet(found)  # the first pass, written once
    rows = spark.read.schema(placed.schema).parquet(found).repartition(tasks, "uri", "start").mapInArrow(read, "value string")
    return rows.select(F.from_json("value", schema).alias("r")).select("r.*")


def write_json_array(df: DataFrame, path: str, group: str, order: str) -> None:
    """Files of JSON arrays, one array per value of ``group`` (which must hold
    few enough rows for one string), in the order of ``order``."""
    rows = F.array_sort(F.collect_list(F.struct(order, F.to_json(F.struct(*df.columns)).alias("__json"))))
    arrays = df.groupBy(group).agg(F.concat(F.lit("["), F.array_join(F.transform(rows, lambda r: r["__json"]), ",\n"),
                                            F.lit("]")).alias("value"))
    arrays.select("value").write.text(path)
