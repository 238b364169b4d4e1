"""Byte-level BPE by overlapping chunks.

A text is a sequence of pre-tokens, the matches of ``pattern`` from left to
right, each encoded for itself by the merge ranks.  Where a match ends is all a
scan remembers, so two scans of one text that share a match end agree from there
on.  Texts over ``chunk`` + ``overlap`` code points are therefore cut into chunks
that read ``overlap`` code points into the next one, and the chunks are rows of
their own: they are pre-tokenised in parallel, a window over the chunks of a text
finds the first match end that both neighbours have in their overlap, and the
stretches between these places are encoded, again in parallel, and put together.
A text with an overlap that does not resynchronise (one match fills it) is
scanned whole, in bounded batches of matches.  A text of one chunk has nothing to
stitch and goes to the library.  Decoding concatenates the bytes of the ids.

Matches ending in the last ``LOOKAHEAD`` code points of a chunk's window are not
trusted, as the cut may change them; a pattern must not look behind, nor further
ahead than that past a match (a run that it reads on reaches the window's end and
is not trusted either).

Cases: a null text counts as empty and gives no ids; texts of any length and any
characters are encoded whole, runs that the library itself overflows on included;
repeated rows stay rows; columns named like the added ones are replaced; an empty
table gives an empty result.  A match is encoded in one piece, whatever its
length.  Memory in a worker: one text or a batch of texts and their ids, and
``MEMORY_BYTES`` of remembered matches.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import stored

CHUNK = 32_768
OVERLAP = 256
LOOKAHEAD = 16
MATCHES = 1 << 16  # matches held at a time
IDS = 1 << 16  # ids decoded at a time
LIBRARY = 1 << 16  # code points that the library may split by itself; it overflows on runs of millions
MEMORY_BYTES = 32 << 20
LONGEST_KEPT = 64  # code points of a remembered match

_codecs: dict[tuple[int, str], Codec] = {}


class Codec:
    """The rank file's vocabulary, its pattern and the ids of matches seen."""

    def __init__(self, data: bytes, pattern: str):
        pairs = (line.split() for line in data.splitlines() if line.strip())
        ranks = {base64.b64decode(token): int(rank) for token, rank in pairs}
        self.pattern = regex.compile(pattern)
        self.library = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.known: dict[str, list[int]] = {}
        self.room = MEMORY_BYTES
        size = max(ranks.values(), default=-1) + 1
        by_id = [b""] * size
        for token, rank in ranks.items():
            by_id[rank] = token
        self.lengths = np.array([len(t) for t in by_id], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.blob = np.frombuffer(b"".join(by_id), np.uint8)

    def ends(self, text: str) -> Iterator[int]:
        return (m.end() for m in self.pattern.finditer(text))

    def matches(self, text: str, lo: int, hi: int) -> Iterator[list[str]]:
        """The matches of ``text`` from ``lo`` that end at ``hi`` or before, in batches."""
        found = (m.group() for m in self.pattern.finditer(text, lo) if m.end() <= hi)
        while batch := list(islice(found, MATCHES)):
            yield batch

    def encode(self, text: str) -> np.ndarray:
        """The ids of a whole text."""
        if len(text) <= LIBRARY:
            return self.library.encode_to_numpy(text, disallowed_special=())
        return self.encode_part(text, 0, len(text))

    def encode_part(self, text: str, lo: int, hi: int) -> np.ndarray:
        """The ids of the matches between two match ends.  What follows ``hi``
        stays in sight of the pattern."""
        out = [np.zeros(0, np.int32)]
        for batch in self.matches(text, lo, hi):
            ids = list(map(self.known.get, batch))
            if None in ids:
                ids = [self._merged(m) if i is None else i for m, i in zip(batch, ids)]
            out.append(np.fromiter(chain.from_iterable(ids), np.int32))
        return np.concatenate(out)

    def _merged(self, match: str) -> list[int]:
        ids = self.known.get(match)
        if ids is None:
            ids = self.library._encode_single_piece(match.encode())
            if len(match) <= LONGEST_KEPT:
                if self.room < 0:
                    self.known.clear()
                    self.room = MEMORY_BYTES
                self.known[match] = ids
                self.room -= 200 + 4 * len(match) + 8 * len(ids)
        return ids

    def decode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The bytes of all ids and the number of bytes of each id."""
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.lengths) or not self.lengths[ids].all()):
            raise ValueError("ids outside the vocabulary")
        lengths, out = self.lengths[ids], []
        for lo in range(0, len(ids), IDS):
            part, n = ids[lo:lo + IDS], lengths[lo:lo + IDS]
            places = np.repeat(self.starts[part] - (np.cumsum(n) - n), n)
            places += np.arange(len(places))
            out.append(self.blob[places].tobytes())
        return b"".join(out), lengths


def _codec(data: bytes, pattern: str) -> Codec:
    """One codec per worker and vocabulary."""
    key = (hash(data), pattern)
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(data, pattern)
    return _codecs[key]


def _rank_file(spark: SparkSession, path: str):
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())  # one vocabulary, about a megabyte


def _lists(rows: list[np.ndarray]) -> pa.Array:
    values = np.concatenate([np.zeros(0, np.int32), *rows]).astype(np.int32)
    offsets = np.cumsum([0, *map(len, rows)], dtype=np.int64).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def _free(name: str, columns: list[str]) -> str:
    while name in columns:
        name += "_"
    return name


def encode_texts(docs: DataFrame, ranks: str, pattern: str, text: str = "text", chunk: int = CHUNK,
                 overlap: int = OVERLAP) -> DataFrame:
    """``docs`` with token_ids (array of int) and n_tokens (long).

    ``ranks``: path of a rank file, read on the driver; ``pattern`` splits texts.
    """
    if overlap <= LOOKAHEAD or chunk < overlap:
        raise ValueError(f"need {LOOKAHEAD} < overlap <= chunk")
    data = _rank_file(docs.sparkSession, ranks)

    @F.arrow_udf("array<int>")
    def encode(texts: pa.Array) -> pa.Array:
        codec = _codec(data.value, pattern)
        return _lists([codec.encode(t.as_py() or "") for t in texts])

    docs = docs.select(*[c for c in docs.columns if c not in ("token_ids", "n_tokens")])
    long = F.coalesce(F.length(text) > chunk + overlap, F.lit(False))
    row = _free("row", docs.columns)
    parts = stored(docs.where(long).withColumn(row, F.monotonically_increasing_id()), "bpe-long")
    ids, whole = _by_chunks(parts.select(F.col(row).alias("row"), F.col(text).alias("text")), data, pattern, chunk, overlap)
    stitched = parts.join(ids.withColumnRenamed("row", row), row)
    unstitched = parts.join(whole.withColumnRenamed("row", row), row, "left_semi").withColumn("token_ids", encode(text))
    out = (docs.where(~long).withColumn("token_ids", encode(text))
           .unionByName(stitched.drop(row)).unionByName(unstitched.drop(row)))
    return out.withColumn("n_tokens", F.size("token_ids").cast("long"))


def _by_chunks(texts: DataFrame, data, pattern: str, chunk: int, overlap: int) -> tuple[DataFrame, DataFrame]:
    """(row, token_ids) of the texts whose chunks resynchronise, and the other rows."""
    def cut(batches):
        for batch in batches:
            for row, t in zip(batch.column("row").to_pylist(), batch.column("text")):
                t = t.as_py()
                starts = range(0, len(t), chunk)
                for lo in range(0, len(starts), 64):
                    part = list(range(lo, min(lo + 64, len(starts))))
                    yield pa.RecordBatch.from_pydict(
                        {"row": pa.array([row] * len(part), pa.int64()), "part": pa.array(part, pa.int32()),
                         "last": [p == len(starts) - 1 for p in part],
                         "ends_text": [(p + 1) * chunk + overlap >= len(t) for p in part],
                         "body": [t[p * chunk:(p + 1) * chunk + overlap] for p in part]})

    @F.arrow_udf("struct<head: array<int>, tail: array<int>>")
    def scan(bodies: pa.Array, ends_text: pa.Array) -> pa.Array:
        codec, heads, tails = _codec(data.value, pattern), [], []
        for body, whole in zip(bodies, ends_text.to_pylist()):
            body = body.as_py()
            ends = np.fromiter(codec.ends(body), np.int32)
            heads.append(np.append(0, ends[ends <= overlap]))
            tails.append(ends[(ends >= chunk) & (ends <= len(body) - (0 if whole else LOOKAHEAD))])
        return pa.StructArray.from_arrays([_lists(heads), _lists(tails)], ["head", "tail"])

    @F.arrow_udf("array<int>")
    def encode(bodies: pa.Array, los: pa.Array, his: pa.Array) -> pa.Array:
        codec = _codec(data.value, pattern)
        return _lists([codec.encode_part(b.as_py(), lo, len(b.as_py()) if hi is None else hi) for b, lo, hi in zip(bodies, los.to_pylist(), his.to_pylist())])

    chunks = texts.mapInArrow(cut, "row long, part int, last boolean, ends_text boolean, body string")
    tasks = texts.sparkSession.sparkContext.defaultParallelism
    scanned = stored(chunks.repartition(4 * tasks, "row", "part").withColumn("ends", scan("body", "ends_text"))
                     .select("row", "part", "last", "body", "ends.head", "ends.tail"), "bpe-chunks")
    # one row per chunk, without its text: a text's chunks are as many as its length allows
    order = Window.partitionBy("row").orderBy("part")
    shared = F.array_min(F.array_intersect("tail", F.transform(F.lead("head").over(order), lambda x: x + F.lit(chunk))))
    cuts = (scanned.select("row", "part", "last", shared.alias("hi"))
            .select("row", "part", "hi", F.coalesce(F.lag("hi").over(order) - chunk, F.lit(0)).alias("lo"),
                    F.every(F.col("last") | F.col("hi").isNotNull()).over(Window.partitionBy("row")).alias("met")))
    pieces = scanned.select("row", "part", "body").join(cuts.where("met"), ["row", "part"])
    pieces = pieces.select("row", "part", encode("body", "lo", "hi").alias("ids"))
    inorder: Column = F.array_sort(F.collect_list(F.struct("part", "ids")))
    ids = pieces.groupBy("row").agg(F.flatten(F.transform(inorder, lambda x: x["ids"])).alias("token_ids"))
    return ids, cuts.where("not met").select("row").distinct()


def decode_ids(df: DataFrame, ranks: str, pattern: str, ids: str = "token_ids", out: str = "decoded") -> DataFrame:
    """``df`` with the bytes of its ids (binary); null ids give null, ids
    outside the vocabulary raise."""
    data = _rank_file(df.sparkSession, ranks)

    @F.arrow_udf("binary")
    def decode(lists: pa.Array) -> pa.Array:
        raw, lengths = _codec(data.value, pattern).decode(lists.flatten().to_numpy(zero_copy_only=False))
        counts = np.array([n or 0 for n in lists.value_lengths().to_pylist()], np.int64)
        cut = np.concatenate([[0], np.cumsum(lengths)])[np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)]
        whole = pa.Array.from_buffers(pa.binary(), len(lists), [None, pa.py_buffer(cut.astype(np.int32)), pa.py_buffer(raw)])
        return whole if not lists.null_count else pa.array([None if n else b for b, n in
                                                            zip(whole.to_pylist(), lists.is_null().to_pylist())], pa.binary())

    return df.withColumn(out, decode(ids))
