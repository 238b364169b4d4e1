"""Removal of repeated passages by hashed runs of consecutive sentences.

A text is cut into sentences at ``.``, ``!`` or ``?`` before white space and at
line breaks; a sentence of more than ``max_words`` words counts as several, cut
every ``max_words`` words.  A *run* is a shortest stretch of consecutive
sentences, from some sentence onwards or back from some sentence, that has at
least ``min_sentences`` sentences and ``min_words`` words.  Every run of every
text is hashed (by its words, so white space does not matter).  Of the
documents that hold a run, the one with the smallest doc_id keeps it, at its
first place; sentences that any other occurrence covers are removed.

Cut by ``content``, a text is cut where its words say so, so that a passage is
cut alike wherever it stands: of any ``max_words`` consecutive words without the
end of a sentence or line, the cut follows the one that, with the word before
it, hashes lowest.  Shared words at least ``max_words`` from the edges of what
two texts share are cut alike in both.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernel

MIN_SENTENCES, MIN_WORDS, MAX_WORDS = 3, 20, 16
_STOPS = np.zeros(256, dtype=bool)
_STOPS[[ord(c) for c in ".!?"]] = True
#: Stops of other scripts: Arabic, Urdu, Armenian, Devanagari, Ethiopic, Burmese, Khmer, CJK, full width.
_MORE_STOPS = [c.encode() for c in "؟۔։।॥።။។…。｡！？．"]
PASSAGE_WORDS, PASSAGE_WINDOW = 20, 8
_STEP = 0xD1342543DE82EF95
_steps = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _step_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_steps["up"]) < n:
        size = max(n, 1 << 19)
        for name, base in (("up", _STEP), ("down", pow(_STEP, -1, 1 << 64))):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            _steps[name] = np.multiply.accumulate(table)
    return _steps["up"], _steps["down"]


def _ends_sentence(raw, starts, ends) -> np.ndarray:
    """Does the word end with a stop of another script?"""
    found = np.zeros(len(ends), bool)
    wide = np.flatnonzero((raw[ends - 1] >= 0x80) & (ends - starts >= 2))
    for stop in _MORE_STOPS:
        at = wide[ends[wide] - starts[wide] >= len(stop)]
        for k, byte in enumerate(reversed(stop)):
            at = at[raw[ends[at] - 1 - k] == byte]
        found[at] = True
    return found


def _sliding(values, width: int, pick) -> np.ndarray:
    """``pick`` (minimum or maximum) over each ``width`` consecutive values."""
    have = 1
    while have * 2 <= width:
        values, have = pick(values[:-have], values[have:]), have * 2
    return pick(values[:len(values) - (width - have)], values[width - have:]) if have < width else values


def _content_cuts(h, stop, width: int) -> np.ndarray:
    """The words after which the text is cut: every stop, and the words that
    are lowest in some window of ``width`` words."""
    if len(h) < width:
        return stop
    before = np.zeros(len(h), np.uint64)
    before[1:] = np.where(stop[:-1], np.uint64(0), h[:-1])
    key = kernel.mix(h + before * np.uint64(_STEP)) | np.uint64(1)
    key[stop] = 0
    low = _sliding(key, width, np.minimum)
    edge = np.zeros(width - 1, np.uint64)
    return stop | (_sliding(np.concatenate([edge, low, edge]), width, np.maximum) == key)


def sentence_runs(raw, offsets, min_sentences: int, min_words: int, max_words: int, content: bool = False):
    """Sentences and runs of the texts of one slice.

    Returns (first byte of each sentence, text number of each sentence, first
    word of each sentence with the end as last entry, run starts, run ends
    (sentences), run hashes); runs are distinct and sorted by start.
    """
    starts, ends, text, h = kernel.words(raw, offsets, lower=False)
    n = len(starts)
    none = np.zeros(0, np.int64)
    if n == 0:
        return none, none, np.zeros(1, np.int64), none, none, np.zeros(0, np.uint64)
    lines = np.zeros(len(raw) + 1, np.int64)
    np.cumsum(raw == 10, out=lines[1:])
    stop = _STOPS[raw[ends - 1]]
    stop[:-1] |= lines[starts[1:]] > lines[ends[:-1]]
    stop[:-1] |= text[1:] != text[:-1]
    stop[-1] = True
    begins = np.ones(n, bool)
    if content:
        begins[1:] = _content_cuts(h, stop | _ends_sentence(raw, starts, ends), max_words)[:-1]
    else:
        begins[1:] = stop[:-1]
        place = np.arange(n)
        place = place - np.maximum.accumulate(np.where(begins, place, 0))
        begins |= place % max_words == 0
    first = np.flatnonzero(begins)
    bounds = np.append(first, n)
    owner = text[first]
    count = len(first)
    i = np.arange(count)
    doc_end = np.searchsorted(owner, owner, side="right")
    doc_begin = np.searchsorted(owner, owner, side="left")
    to = np.maximum(np.searchsorted(bounds[1:], bounds[:-1] + min_words, side="left") + 1, i + min_sentences)
    ok = to <= doc_end
    since = np.minimum(np.searchsorted(bounds[:-1], bounds[1:] - min_words, side="right") - 1, i + 1 - min_sentences)
    ok2 = since >= doc_begin
    run = np.unique(np.concatenate([(i[ok] << 32) | to[ok], (since[ok2] << 32) | (i[ok2] + 1)]))
    a, b = run >> 32, run & 0xFFFFFFFF
    up, down = _step_tables(n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(h * up[:n], out=total[1:])
    s, e = bounds[a], bounds[b]
    value = kernel.mix((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64))
    return starts[first], owner, bounds, a, b, value


def _first_places(owner_of_run, value):
    """True for the first place of each hash in its text (runs are in order)."""
    order = np.lexsort((np.arange(len(value)), value, owner_of_run))
    same = np.zeros(len(value), bool)
    o, v = owner_of_run[order], value[order]
    same[1:] = (o[1:] == o[:-1]) & (v[1:] == v[:-1])
    first = np.ones(len(value), bool)
    first[order[same]] = False
    return first


def _run_rows(batches, sizes):
    """(run, doc_id), each run once per text."""
    for batch in batches:
        doc = batch.column("doc_id").to_numpy(zero_copy_only=False)
        for lo, _, raw, offsets in kernel.slices(batch.column("text")):
            _, owner, _, a, _, value = sentence_runs(raw, offsets, *sizes)
            if len(a):
                first = _first_places(owner[a], value)
                yield pa.RecordBatch.from_pydict({
                    "run": pa.array(kernel.signed(value[first])),
                    "doc_id": pa.array(doc[lo + owner[a][first]].astype(np.int64))})


def _cleaned(batches, sizes, schema: pa.Schema):
    """The texts without the sentences that repeated runs cover."""
    for batch in batches:
        gone_column = batch.column("gone")
        out = {name: [] for name in ("text", "n_sentences", "n_words", "n_removed", "n_removed_words", "spans")}
        texts = batch.column("text")
        for lo, hi, raw, offsets in kernel.slices(texts):
            at, owner, bounds, a, b, value = sentence_runs(raw, offsets, *sizes)
            first = _first_places(owner[a], value) if len(a) else np.zeros(0, bool)
            sentence_lo = np.searchsorted(owner, np.arange(hi - lo + 1))
            run_lo = np.searchsorted(a, sentence_lo)
            for k in range(hi - lo):
                s0, s1, r0, r1 = sentence_lo[k], sentence_lo[k + 1], run_lo[k], run_lo[k + 1]
                repeated = ~first[r0:r1]
                gone = gone_column[lo + k]
                if gone.is_valid and r1 > r0:
                    repeated |= np.isin(kernel.signed(value[r0:r1]), np.asarray(gone.values))
                change = np.zeros(s1 - s0 + 1, np.int64)
                np.add.at(change, a[r0:r1][repeated] - s0, 1)
                np.add.at(change, b[r0:r1][repeated] - s0, -1)
                covered = np.cumsum(change[:-1]) > 0
                out["n_sentences"].append(int(s1 - s0))
                out["n_words"].append(int(bounds[s1] - bounds[s0]) if s1 > s0 else 0)
                out["n_removed"].append(int(covered.sum()))
                out["n_removed_words"].append(int((bounds[s0 + 1:s1 + 1] - bounds[s0:s1])[covered].sum()))
                whole = raw[offsets[k]:offsets[k + 1]].tobytes()
                if not covered.any():
                    out["text"].append(whole.decode() if texts[lo + k].is_valid else None)
                    out["spans"].append([])
                    continue
                edge = np.append(at[s0:s1], offsets[k + 1]) - offsets[k]
                edge[0] = 0
                kept = b"".join(whole[edge[j]:edge[j + 1]] for j in np.flatnonzero(~covered))
                out["text"].append((kept.rstrip(b" \t\n\v\f\r") if covered[-1] else kept).decode())
                chars = np.zeros(len(whole) + 1, np.int64)
                np.cumsum((np.frombuffer(whole, np.uint8) & 0xC0) != 0x80, out=chars[1:])
                flips = np.flatnonzero(np.diff(np.concatenate(([0], covered.astype(np.int8), [0]))))
                out["spans"].append([{"begin": int(chars[edge[x]]), "end": int(chars[edge[y]])}
                                     for x, y in zip(flips[::2], flips[1::2])])
        row = batch.column("row")
        yield pa.RecordBatch.from_arrays(
            [row] + [pa.array(out[f.name], f.type) for f in list(schema)[1:]], names=schema.names)


def remove_repeated_spans(docs: DataFrame, min_sentences: int = MIN_SENTENCES, min_words: int = MIN_WORDS,
                          max_words: int = MAX_WORDS, content: bool = False) -> DataFrame:
    """Every row of ``docs`` with its text cleaned: the columns of ``docs``
    (text replaced) and after them n_sentences, n_words, n_removed,
    n_removed_words (of the text before) and spans, the removed stretches as
    code point offsets into the text before.

    Null texts stay null; empty ones, and texts with fewer than
    ``min_sentences`` sentences or ``min_words`` words, have no run and stay as
    they are.  Rows with a null doc_id lose only what repeats within them.
    Rows that share a doc_id count as one document.  A text that loses every
    sentence becomes the empty string.  Columns of ``docs`` named like one of
    the five added columns are replaced by it.
    """
    sizes = (min_sentences, min_words, max_words, content)
    doc_id, text = F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")
    runs = (docs.where("doc_id is not null").select(doc_id, text)
            .mapInArrow(lambda it: _run_rows(it, sizes), "run long, doc_id long"))
    shared = (runs.groupBy("run").agg(F.min("doc_id").alias("keeper"), F.max("doc_id").alias("other"))
              .where("keeper < other").select("run", "keeper"))
    gone = (runs.join(shared, "run").where("doc_id > keeper")
            .groupBy("doc_id").agg(F.collect_set("run").alias("gone")))
    packed = docs.select(F.struct(*[docs[c] for c in docs.columns if c != "text"]).alias("row"), doc_id, text)
    extra = [T.StructField("text", T.StringType()), *[T.StructField(c, T.LongType()) for c in
             ("n_sentences", "n_words", "n_removed", "n_removed_words")],
             T.StructField("spans", T.ArrayType(T.StructType([T.StructField("begin", T.LongType()),
                                                              T.StructField("end", T.LongType())])))]
    schema = T.StructType([T.StructField("row", packed.schema["row"].dataType), *extra])
    from pyspark.sql.pandas.types import to_arrow_schema
    arrow = to_arrow_schema(T.StructType([T.StructField("row", T.LongType()), *extra]))
    cleaned = packed.join(gone, "doc_id", "left").mapInArrow(lambda it: _cleaned(it, sizes, arrow), schema)
    added = [f.name for f in extra]
    return cleaned.select(*[F.col("text") if c == "text" else F.col("row")[c].alias(c)
                            for c in docs.columns if c == "text" or c not in added], *added[1:])


def remove_repeated_passages(docs: DataFrame, min_words: int = PASSAGE_WORDS,
                             window: int = PASSAGE_WINDOW) -> DataFrame:
    """``remove_repeated_spans`` with cuts by content and runs of any number of
    pieces: of a stretch that documents share, all but less than 2 * ``window``
    words at either edge goes, wherever it stands in them, if it has
    ``min_words`` + 4 * ``window`` words or more (often fewer do).  n_sentences
    and n_removed count pieces.
    """
    return remove_repeated_spans(docs, 1, min_words, window, True)
