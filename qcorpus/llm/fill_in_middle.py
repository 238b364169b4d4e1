"""Fill-in-middle transformation by repeated captures.

A text is a sequence of units (``[A-Za-z]+|[^A-Za-z]``).  One ``fullmatch`` of
``(unit)*`` with the ``regex`` library keeps every repetition of its group:
``match.ends(1)`` lists where the units end, so its length is the number of units
n and its entries are both cut offsets.  Only n and the two offsets leave the
worker; cutting and joining are column functions.

The parts are prefix, middle and suffix of the text, cut after two of its n units.
The numbers h1 to h4 are taken from the SHA-256 of ``seed:id``; the cuts are
h1 % (n + 1) and h2 % (n + 1), the smaller first, h3 and h4 choose the form.
Plain texts stay as they are: empty ones, those holding a marker, and a share.

Cases: a null text counts as empty (plain); a null id is hashed as an empty
string; repeated rows stay rows and get the same cuts; columns named like the
added ones are replaced; an empty table gives an empty result.  A text longer
than ``SLICE`` code points is matched slice by slice, cut where no unit spans,
since the library holds every capture in memory: first to count, then again for
the slices of the two cuts, so memory is bounded by the text and one slice.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

SLICE = 1 << 18
MARKERS = ("<P>", "<S>", "<M>")  # prefix, suffix, middle
PLAIN_FROM = 90  # of 100
SPM_BELOW = 20  # of 100

_UNITS = regex.compile(r"([A-Za-z]+|[^A-Za-z])*")
_LETTERS = regex.compile(r"[A-Za-z]*")


def _slices(text: str, size: int) -> Iterator[tuple[int, int]]:
    """Ranges of about ``size`` code points that no run of letters spans."""
    lo = 0
    while lo < len(text):
        hi = min(lo + size, len(text))
        if hi < len(text) and _LETTERS.fullmatch(text, hi - 1, hi + 1):
            hi = _LETTERS.match(text, hi).end()
        yield lo, hi
        lo = hi


def _ends(text: str, lo: int, hi: int) -> list[int]:
    return _UNITS.fullmatch(text, lo, hi).ends(1)


def cuts(text: str, h1: int, h2: int, size: int = SLICE) -> tuple[int, int, int]:
    """(n, end of the prefix, end of the middle), offsets in code points."""
    if len(text) <= size:
        ends = _ends(text, 0, len(text))
        n = len(ends)
        at = sorted((h1 % (n + 1), h2 % (n + 1)))
        return n, *(ends[k - 1] if k else 0 for k in at)
    ranges = [(lo, hi, len(_ends(text, lo, hi))) for lo, hi in _slices(text, size)]
    n = sum(count for *_, count in ranges)
    offsets = []
    for k in sorted((h1 % (n + 1), h2 % (n + 1))):
        place = 0
        for lo, hi, count in ranges:
            if 0 < k <= count:
                place = _ends(text, lo, hi)[k - 1]
                break
            k -= count
        offsets.append(place)
    return n, *offsets


@F.arrow_udf(StructType().add("n", LongType()).add("first", LongType()).add("second", LongType()))
def _cut(texts: pa.Array, h1: pa.Array, h2: pa.Array) -> pa.Array:
    rows = [cuts(t.as_py(), a, b) for t, a, b in zip(texts, h1.to_pylist(), h2.to_pylist())]
    columns = zip(*rows) if rows else ([], [], [])
    return pa.StructArray.from_arrays([pa.array(list(c), pa.int64()) for c in columns], ["n", "first", "second"])


def _has_marker(text: Column) -> Column:
    found = F.lit(False)
    for m in MARKERS:
        found = found | F.contains(text, F.lit(m))
    return found


def fill_in_middle(docs: DataFrame, key: str = "doc_id", text: str = "text", seed: str = "1") -> DataFrame:
    """``docs`` with n (long), form (plain, psm or spm), prefix_chars,
    middle_chars (long, null if plain) and output (string)."""
    added = ("n", "form", "prefix_chars", "middle_chars", "output")
    names = [c for c in docs.columns if c not in added]
    body = F.coalesce(F.col(text), F.lit(""))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))), 256)
    h1, h2, h3, h4 = (F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4))
    plain = (body == "") | _has_marker(body) | (h3 % 100 >= PLAIN_FROM)
    form = F.when(plain, "plain").when(h4 % 100 < SPM_BELOW, "spm").otherwise("psm")
    b, f, c = (_free(x, names) for x in ("body", "how", "cut"))
    wide = docs.select(*names, body.alias(b), form.alias(f), _cut(body, h1, h2).alias(c))
    first, second = F.col(c)["first"], F.col(c)["second"]
    p, s, m = map(F.lit, MARKERS)
    prefix = F.substring(b, F.lit(1), first.cast("int"))
    middle = F.substring(b, (first + 1).cast("int"), (second - first).cast("int"))
    suffix = F.substring(b, (second + 1).cast("int"), F.length(b))
    output = (F.when(F.col(f) == "plain", F.col(b)).when(F.col(f) == "psm", F.concat(p, prefix, s, suffix, m, middle))
              .otherwise(F.concat(s, suffix, p, prefix, m, middle)))
    cut = F.col(f) != "plain"
    return wide.select(*names, F.col(c)["n"].alias("n"), F.col(f).alias("form"), F.when(cut, first).alias("prefix_chars"),
                       F.when(cut, second - first).alias("middle_chars"), output.alias("output"))


def _free(name: str, columns: list[str]) -> str:
    while name in columns:
        name += "_"
    return name


def restored(output: str | Column = "output", form: str | Column = "form") -> Column:
    """The text that ``output`` was made from.  The parts hold no marker and no
    marker overlaps another, so each one is found at its first place."""
    output, form = (F.col(c) if isinstance(c, str) else c for c in (output, form))

    def between(a: str, b: str) -> Column:
        lo = F.locate(a, output) + len(a)
        return F.substring(output, lo, F.locate(b, output) - lo)

    p, s, m = MARKERS
    last = F.substring(output, F.locate(m, output) + len(m), F.length(output))
    return (F.when(form == "plain", output)
            .when(form == "psm", F.concat(between(p, s), last, between(s, m)))
            .when(form == "spm", F.concat(between(p, m), last, between(s, p))))
