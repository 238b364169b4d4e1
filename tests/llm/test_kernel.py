"""Word hashing in slices and chunks; batches bounded in bytes."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from qcorpus.llm import kernel, scratch


@pytest.mark.parametrize("prefixes", [(), (3, 5)])
def test_chunks_of_a_long_text_change_nothing(monkeypatch, prefixes):
    rng = random.Random(1)
    text = " ".join("W" + "x" * rng.randrange(12) + rng.choice(["\n", "", "\t "]) + str(rng.randrange(99)) for _ in range(3000))
    raw = np.frombuffer((text + " " + "y" * 5000 + "  end").encode(), np.uint8)
    whole = kernel.words(raw, np.array([0, len(raw)]), True, prefixes)
    monkeypatch.setattr(kernel, "SLICE_BYTES", 300)
    assert len(list(kernel._chunks(raw))) > 20
    for x, y in zip(whole, kernel.words(raw, np.array([0, len(raw)]), True, prefixes)):
        assert np.array_equal(x, y)


def test_a_long_text_takes_little_memory():
    """48 MB of words: beside the text, far below 50 bytes a byte."""
    raw = np.frombuffer(b"some words of a long text " * 1_850_000, np.uint8)
    tracemalloc.start()
    _, _, _, h = kernel.words(raw, np.array([0, len(raw)]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(h) == 6 * 1_850_000 and peak < 17 * len(raw)


def test_batches_are_bounded_in_bytes_and_the_setting_comes_back(spark):
    rows = spark.range(0, 40, 1, 1).selectExpr("repeat('x', 1 << 20) AS text")

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": pa.array([b.num_rows])})
    out = scratch.stored(rows.mapInArrow(sizes, "n long"), "sizes").collect()
    assert sum(r["n"] for r in out) == 40 and max(r["n"] for r in out) <= 5
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None
