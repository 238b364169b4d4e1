"""Vectorised word hashing over Arrow string columns.

Used inside ``mapInArrow`` functions.  A batch is cut into slices of 256 KB, so
the working arrays (about 50 bytes a byte) stay small whatever the batch holds.  A
single text longer than that forms a slice of its own; its words are found chunk
by chunk, cut at white space, which leaves 32 bytes a word.  Only a stretch without
white space is never cut.  Words are the runs of bytes
other than ASCII white space; since every UTF-8 continuation byte is above
0x7F, byte runs and code point runs agree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 18

SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_FACTORS = np.array([0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3,
                     0x1D8E4E27C47D124F, 0xEB44ACCAB455D165, 0x9C6E6877736C46E3, 0xD6E8FEB86659FD93],
                    dtype=np.uint64)
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values (SplitMix64's)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers["up"]) < n:
        size = max(n, SLICE_BYTES)
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            _powers[name] = np.multiply.accumulate(table)
    return _powers["up"], _powers["down"]


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Consecutive row ranges of a string column as (first row, end row,
    bytes, offsets into these bytes).  Null counts as the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if n == 0:
        return
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offset_buffer, data = column.buffers()
    kind = np.int64 if wide else np.int32
    offsets = np.frombuffer(offset_buffer, kind)[column.offset:column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield lo, hi, raw[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo]
        lo = hi


def words(raw: np.ndarray, offsets: np.ndarray, lower: bool = True, prefixes: tuple[int, ...] = ()):
    """Words of the texts as (start, end, text number, hash); A-Z are
    lowered before hashing when ``lower``.  With ``prefixes`` (lengths in bytes)
    the hash is a row of a matrix whose other rows are the hashes of the
    words' beginnings, 0 for words that are not longer."""
    n = len(raw)
    if n > 2 * SLICE_BYTES and len(offsets) == 2:
        cuts = list(_chunks(raw))
        if len(cuts) > 1:
            parts = [(lo, words(raw[lo:hi], np.array([0, hi - lo]), lower, prefixes)) for lo, hi in cuts]
            return (np.concatenate([lo + p[0] for lo, p in parts]), np.concatenate([lo + p[1] for lo, p in parts]),
                    np.concatenate([p[2] for _, p in parts]), np.concatenate([p[3] for _, p in parts], axis=-1))
    if n == 0:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty, np.zeros((1 + len(prefixes), 0) if prefixes else 0, np.uint64)
    inside = ~SPACE[raw]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    first = offsets[:-1]
    before[first[first < n]] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    last = offsets[1:] - 1
    after[last[last >= 0]] = False
    ends = np.flatnonzero(inside & ~after) + 1
    up, down = _power_tables(n)
    value = (LOWER[raw] if lower else raw).astype(np.uint64)
    value += np.uint64(1)
    value *= up[:n]
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(value, out=total[1:])
    h = mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _FACTORS[4])
    counts = np.searchsorted(starts, offsets)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(counts))
    if prefixes:
        rows = [h]
        for k in prefixes:
            cut = np.minimum(starts + k, ends)
            part = mix((total[cut] - total[starts]) * down[starts] + _FACTORS[3:4] * np.uint64(k))
            part[cut == ends] = 0
            rows.append(part)
        h = np.stack(rows)
    return starts, ends, text, h


def _chunks(raw: np.ndarray) -> Iterator[tuple[int, int]]:
    """Consecutive stretches of a text of about ``SLICE_BYTES`` that end at
    white space or at the text's end."""
    lo, n = 0, len(raw)
    while lo < n:
        hi = lo + SLICE_BYTES
        while hi < n:
            found = np.flatnonzero(SPACE[raw[hi:hi + SLICE_BYTES]])
            if len(found):
                hi += int(found[0])
                break
            hi += SLICE_BYTES
        hi = min(hi, n)
        yield lo, hi
        lo = hi


def shingles(text: np.ndarray, h: np.ndarray, n_texts: int, size: int) -> list[np.ndarray]:
    """Per text the sorted distinct hashes of its runs of ``size`` words; a
    shorter non-empty text gives one hash of its whole word sequence."""
    bounds = np.searchsorted(text, np.arange(n_texts + 1))
    if len(h) >= size:
        m = len(h) - size + 1
        run = h[:m] * _FACTORS[0]
        for k in range(1, size):
            run = run + h[k:k + m] * _FACTORS[k]
        run = mix(run)
    else:
        run = np.zeros(0, np.uint64)
    out = []
    for i in range(n_texts):
        lo, hi = int(bounds[i]), int(bounds[i + 1])
        if hi - lo >= size:
            out.append(unique(run[lo:hi - size + 1]))
        elif hi > lo:
            whole = np.array([hi - lo], np.uint64) * _FACTORS[7]
            for k in range(hi - lo):
                whole = whole + h[lo + k:lo + k + 1] * _FACTORS[k]
            out.append(mix(whole))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def unique(values: np.ndarray) -> np.ndarray:
    """Sorted distinct values."""
    values = np.sort(values)
    if len(values) < 2:
        return values
    keep = np.empty(len(values), bool)
    keep[0] = True
    np.not_equal(values[1:], values[:-1], out=keep[1:])
    return values[keep]


def signed(values: np.ndarray) -> np.ndarray:
    """The same 64 bits as Spark's signed long."""
    return np.ascontiguousarray(values, dtype=np.uint64).view(np.int64)


def set_id(values: np.ndarray) -> int:
    """A 64-bit id of a set of distinct hashes, as a signed long."""
    if not len(values):
        return 0
    with np.errstate(over="ignore"):
        total = mix(values + _FACTORS[5]).sum(dtype=np.uint64) + np.uint64(len(values)) * _FACTORS[6]
    return int(mix(np.array([total], np.uint64)).view(np.int64)[0])
