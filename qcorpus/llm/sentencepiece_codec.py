"""SentencePiece encoding and decoding on the ``tokenizers`` library.

The model protobuf is parsed here; from it are rebuilt the normaliser
(precompiled character map, white space rules, dummy prefix), the metaspace
marker, the model (unigram scores, or BPE merges derived from the scores) and
byte fallback.  The model file is read once on the driver, through Spark, and
travels with the tasks (it is checked to be small).

If no piece has the marker after another character, no piece crosses the
start of a word, so a text's ids are the ids of its words, one after another.
Words met for the first time by a Python worker are encoded in one
multithreaded batch, decoded, and compared with the SentencePiece library
(parity); a bounded memory keeps them.  Models with such pieces, or unigram
models, are encoded by whole texts, in batches.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = range(1, 7)  # piece types of the format
UNIGRAM, BPE = 1, 2  # model types of the format
MAX_MODEL_BYTES = 64 << 20
MEMORY_BYTES = 40 << 20  # of words that a worker remembers, with what they take in its tables
LEARNED_AT_ONCE = 8192  # words in one batch of the tokenizer
LONGEST_KEPT = 64  # characters of a remembered word


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a protobuf message."""
    at, end = 0, len(data)

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 0x7F) << shift
            if byte < 0x80:
                return value
            shift += 7
    while at < end:
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(kind) or varint()
            yield tag >> 3, data[at:at + size]
            at += size


@dataclass
class Model:
    """What a SentencePiece model file holds."""
    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    remove_extra_white: bool = True

    @property
    def unk_id(self) -> int:
        return next((i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN), 0)


def parse_model(data: bytes) -> Model:
    model = Model()
    for number, value in _fields(data):
        if number == 1:
            piece, score, kind = "", 0.0, NORMAL
            for n, v in _fields(value):
                if n == 1:
                    piece = v.decode()
                elif n == 2:
                    score = struct.unpack("<f", v)[0]
                elif n == 3:
                    kind = v
            model.pieces.append((piece, score, kind))
        elif number == 2:
            for n, v in _fields(value):
                if n == 3:
                    model.kind = v
                elif n == 35:
                    model.byte_fallback = bool(v)
        elif number == 3:
            for n, v in _fields(value):
                if n == 2:
                    model.charsmap = v
                elif n == 3:
                    model.dummy_prefix = bool(v)
                elif n == 4:
                    model.remove_extra_white = bool(v)
    return model


def build(model: Model):
    """(tokenizer with normaliser and decoder, tokenizer of words that carry
    their marker already)."""
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers

    names = [p[0] for p in model.pieces]
    ids = {name: i for i, name in enumerate(names)}
    if model.kind == BPE:
        plain = [(name, score) for name, score, kind in model.pieces if kind in (NORMAL, USER_DEFINED)]
        usable = {name for name, _ in plain}
        merges = []
        for name, score in plain:
            cuts = [(name[:k], name[k:]) for k in range(1, len(name))]
            cuts = [(a, b) for a, b in cuts if a in usable and b in usable]
            merges += [(-score, ids[name], ids[a], ids[b], a, b) for a, b in cuts]
        merges.sort()
        backend = models.BPE(vocab=ids, merges=[(m[4], m[5]) for m in merges], unk_token=names[model.unk_id],
                             fuse_unk=True, byte_fallback=model.byte_fallback)
    elif model.kind == UNIGRAM:
        backend = models.Unigram([(name, score) for name, score, _ in model.pieces], model.unk_id, model.byte_fallback)
    else:
        raise ValueError(f"model type {model.kind} is not supported")
    bare = Tokenizer(backend)
    whole = Tokenizer(backend)
    steps = [normalizers.Precompiled(model.charsmap)] if model.charsmap else []
    if model.remove_extra_white:
        steps += [normalizers.Replace(Regex(" {2,}"), " "), normalizers.Strip()]
    if model.dummy_prefix:
        steps.append(normalizers.Prepend(MARK))
    whole.normalizer = normalizers.Sequence([*steps, normalizers.Replace(" ", MARK)])
    strip = [decoders.Strip(" ", 1, 0)] if model.dummy_prefix else []
    whole.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *strip])
    return whole, bare


def piece_bytes(model: Model) -> list[bytes]:
    """The bytes that each id stands for; control pieces stand for none."""
    out = []
    for name, _, kind in model.pieces:
        if kind == BYTE:
            out.append(bytes([int(name[3:5], 16)]))
        elif kind in (CONTROL, UNUSED):
            out.append(b"")
        elif kind == UNKNOWN:
            out.append(" ⁇ ".encode())
        else:
            out.append(name.replace(MARK, " ").encode())
    return out


class Codec:
    """Encoder, decoder and parity check of one worker."""

    def __init__(self, data: bytes, threads: int = 2, parity: bool = True):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "true")
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        self.model = parse_model(data)
        self.whole, self.bare = build(self.model)
        self.table = piece_bytes(self.model)
        self.threads = threads
        self.library = None
        if parity:
            import sentencepiece
            self.library = sentencepiece.SentencePieceProcessor(model_proto=data)
        self.by_word = (self.model.kind == BPE and not self.model.remove_extra_white and self.model.dummy_prefix
                        and not any(MARK in p[0].lstrip(MARK) for p in self.model.pieces if p[2] != CONTROL))
        self.known: dict[str, bytes] = {}
        self.held = 0  # bytes of known
        self.odd: set[str] = set()  # words whose ids differ from the library's

    def normalised(self, text: str) -> str:
        """What decoding gives back: the text as the model sees it."""
        if not text:
            return ""
        shown = self.whole.normalizer.normalize_str(text) if (self.model.charsmap or self.model.remove_extra_white) \
            else MARK + text
        return shown.replace(MARK, " ")[1 if self.model.dummy_prefix else 0:]

    def _words(self, text: str) -> list[str]:
        """The words of a text; white space before a word beyond the marker's
        one space belongs to it."""
        parts = text.split(" ")
        if "" not in parts:
            return parts
        out, spaces = [], 0
        for k, part in enumerate(parts):
            if part or k == len(parts) - 1:
                out.append(" " * spaces + part)
                spaces = 0
            else:
                spaces += 1
        return out

    def _learn(self, words: set[str]) -> None:
        fresh = [w for w in words if w not in self.known]
        for lo in range(0, len(fresh), LEARNED_AT_ONCE):
            part = fresh[lo:lo + LEARNED_AT_ONCE]
            marked = [MARK + w.replace(" ", MARK) for w in part]
            encoded = [e.ids for e in self.bare.encode_batch_fast(marked, add_special_tokens=False)]
            if self.library is not None:
                for w, a, b in zip(part, encoded, self.library.encode(part, num_threads=self.threads)):
                    # the library gives nothing for an empty text; inside a text an empty last word is a bare marker
                    if w and a != b:
                        self.odd.add(w)
            self.known.update(zip(part, (np.array(e, np.int32).tobytes() for e in encoded)))

    def encode(self, texts: list[str]) -> tuple[list[np.ndarray], list[bool | None]]:
        """Ids of each text, and whether they agree with the library (None
        without a parity check)."""
        if not self.by_word:
            ids = [np.array(e.ids, np.int32) for e in self.whole.encode_batch_fast(texts, add_special_tokens=False)]
            if self.library is None:
                return ids, [None] * len(ids)
            return ids, [list(a) == b for a, b in zip(ids, self.library.encode(texts, num_threads=self.threads))]
        shown = [self.normalised(t) for t in texts] if self.model.charsmap else texts
        split = [self._words(t) if t else [] for t in shown]
        fresh = set().union(*split) - self.known.keys() if split else set()
        self._learn(fresh)
        get = self.known.__getitem__
        ids = [np.frombuffer(b"".join(map(get, words)), np.int32) for words in split]
        same = [None if self.library is None else not self.odd or self.odd.isdisjoint(words) for words in split]
        self._forget(fresh)
        return ids, same

    def _forget(self, fresh: set[str]) -> None:
        """Long words are not remembered, and nothing is beyond ``MEMORY_BYTES``."""
        for w in fresh:
            if len(w) > LONGEST_KEPT:
                del self.known[w]
                self.odd.discard(w)
            else:
                self.held += 200 + len(w) + len(self.known[w])
        if self.held > MEMORY_BYTES:
            self.known.clear()
            self.odd.clear()
            self.held = 0

    def decode(self, ids: np.ndarray) -> str:
        text = b"".join(map(self.table.__getitem__, ids.tolist())).decode("utf-8", "replace")
        return text[1:] if self.model.dummy_prefix and text.startswith(" ") else text


_codecs: dict[tuple, Codec] = {}


def codec(data: bytes, threads: int, parity: bool) -> Codec:
    """The worker's codec, built once."""
    import hashlib
    key = (hashlib.sha256(data).digest(), threads, parity)
    if key not in _codecs:
        _codecs[key] = Codec(data, threads, parity)
    return _codecs[key]


def read_model(spark: SparkSession, path: str) -> bytes:
    """The bytes of a model file, from any store that Spark reads."""
    row = spark.read.format("binaryFile").load(path).select("length", "content").where(
        F.col("length") <= MAX_MODEL_BYTES).first()
    if row is None:
        raise ValueError(f"{path} holds no model of at most {MAX_MODEL_BYTES} bytes")
    return bytes(row["content"])


def _batches(column: pa.Array, limit: int = 4 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes of text (one row at least)."""
    import pyarrow.compute as pc
    sizes = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    lo = 0
    while lo < len(sizes):
        before = sizes[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(sizes, before + limit, side="right")))
        yield lo, hi
        lo = hi


def encode_texts(docs: DataFrame, model_path: str, threads: int = 2, parity: bool = True) -> DataFrame:
    """``docs`` with token_ids (array<int>), n_tokens, roundtrip and parity;
    columns of ``docs`` with these names are replaced.

    ``roundtrip`` tells whether decoding the ids gives the normalised text back,
    ``parity`` whether the SentencePiece library gives the same ids (null if not
    asked for).  A null text has null token_ids and roundtrip and n_tokens 0; an
    empty one an empty array.  Every text is encoded whole.  An empty table
    gives an empty result.
    """
    data = read_model(docs.sparkSession, model_path)
    added = T.StructType([T.StructField("token_ids", T.ArrayType(T.IntegerType())), T.StructField("n_tokens", T.LongType()),
                          T.StructField("roundtrip", T.BooleanType()), T.StructField("parity", T.BooleanType())])
    names = [c for c in docs.columns if c not in added.names]
    packed = docs.select(F.struct(*[docs[c] for c in names]).alias("row"), docs["text"].cast("string").alias("text"))

    def encoded(batches):
        own = codec(data, threads, parity)
        for batch in batches:
            for lo, hi in _batches(batch.column("text")):
                texts = batch.column("text")[lo:hi].to_pylist()
                ids, same = own.encode([t or "" for t in texts])
                back = [None if t is None else own.decode(i) == own.normalised(t) for t, i in zip(texts, ids)]
                offsets = np.zeros(len(ids) + 1, np.int32)
                np.cumsum([len(i) for i in ids], out=offsets[1:])
                missing = np.array([t is None for t in texts])
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids)),
                                                 mask=pa.array(missing))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("row")[lo:hi], lists, pa.array([len(i) for i in ids], pa.int64()),
                     pa.array(back, pa.bool_()), pa.array(same, pa.bool_())],
                    names=["row", *added.names])
    schema = T.StructType([packed.schema["row"], *added.fields])
    return packed.mapInArrow(encoded, schema).select("row.*", *added.names)


def decode_tokens(tokens: DataFrame, model_path: str, column: str = "token_ids") -> DataFrame:
    """``tokens`` with the column ``text`` decoded from ``column``; null ids
    give a null text."""
    data = read_model(tokens.sparkSession, model_path)

    @F.pandas_udf("string")
    def decoded(ids):
        own = codec(data, 1, False)
        return ids.map(lambda i: None if i is None else own.decode(np.asarray(i, np.int32)))
    return tokens.withColumn("text", decoded(column))
