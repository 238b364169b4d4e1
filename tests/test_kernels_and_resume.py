"""Greedy matching in tiles (C12) and resume by a key filter (A11) against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from qcorpus.operators.evaluate import greedy_match_score
from qcorpus.sources.records import key_filter, pending

SCHEMA = "pair_id long, side int, pos int, embedding array<double>"


def brute(rows):
    pairs = {}
    for pair, side, _, v in rows:
        own = pairs.setdefault(pair, ([], []))
        if v is not None and side in (0, 1):
            length = np.linalg.norm(v)
            own[side].append(np.array(v) / length if length else np.array(v))
    out = {}
    for pair, (p, g) in pairs.items():
        if not p or not g:
            out[pair] = (0.0, 0.0)
            continue
        cosines = np.array(p) @ np.array(g).T
        out[pair] = (cosines.max(axis=1).mean(), cosines.max(axis=0).mean())
    return out


@pytest.mark.parametrize("tile", [3, 7, 1024])
def test_greedy_match_equals_brute_force(spark, tile):
    rng = np.random.default_rng(tile)
    rows = [(pair, side, pos, [float(x) for x in rng.normal(size=4)])
            for pair, sizes in enumerate([(1, 1), (5, 9), (40, 2), (0, 4), (4, 0), (60, 61)])
            for side in (0, 1) for pos in range(sizes[side])]
    rows += [(6, 0, 0, None), (6, 1, 0, [1.0, 0.0, 0.0, 0.0]), (7, 0, 0, [0.0] * 4), (7, 1, 0, [0.0, 1.0, 0.0, 0.0]),
             (None, 0, 0, [1.0, 0.0, 0.0, 0.0]), (None, 1, 0, [1.0, 1.0, 0.0, 0.0]), (8, 5, 0, [1.0, 0.0, 0.0, 0.0])]
    rows += rows[:12]  # repeated rows are tokens of their own
    got = {r[0]: r[1:] for r in greedy_match_score(spark.createDataFrame(rows, SCHEMA), tile=tile).collect()}
    want = brute(rows)
    assert got.keys() == want.keys()
    for pair, (p, r) in want.items():
        f1 = 2 * p * r / (p + r) if p + r else 0.0
        assert np.allclose(got[pair], (p, r, f1), atol=1e-12), pair


def test_greedy_match_of_long_sides_and_of_nothing(spark):
    rng = np.random.default_rng(1)
    rows = [(1, side, pos, [float(x) for x in rng.normal(size=8)]) for side in (0, 1) for pos in range(2000)]
    got = greedy_match_score(spark.createDataFrame(rows, SCHEMA)).first()
    assert np.allclose(got[1:3], brute(rows)[1], atol=1e-12)
    assert greedy_match_score(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("expected", [10, 100_000])
def test_pending_equals_anti_join(spark, expected):
    """Also with a filter far too small for the keys."""
    items = spark.range(30_000).select(F.when(F.col("id") % 1000 == 7, None).otherwise(F.col("id") % 20_000).alias("key"),
                                       F.col("id").cast("string").alias("name"))
    done = spark.range(0, 40_000, 3).select(F.when(F.col("id") % 999 == 0, None).otherwise(F.col("id")).alias("key"),
                                            (F.col("id") % 6 == 0).alias("failed"))
    for retry in (False, True):
        left = done.where("not failed") if retry else done
        want = items.join(left, "key", "left_anti")
        got = pending(items, done, "key", retry_failed=retry, expected=expected)
        assert got.columns == want.columns
        assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    both = pending(items, done.select("key", F.col("key").cast("string").alias("name")), ["key", "name"], expected=expected)
    assert both.count() == items.join(done.select("key", F.col("key").cast("string").alias("name")), ["key", "name"],
                                      "left_anti").count()
    for kind in ("int", "double"):  # types that differ or that the filter does not take
        other = done.select(F.col("key").cast(kind).alias("key"))
        assert pending(items, other, "key", expected=expected).count() == items.join(other, "key", "left_anti").count()
    assert pending(items, done.limit(0), "key", expected=expected).count() == 30_000


def test_unfinished_items_are_not_shuffled(spark):
    """The filter lets few of the unfinished items through to the join."""
    items, done = spark.range(50_000).withColumnRenamed("id", "key"), spark.range(20_000).withColumnRenamed("id", "key")
    words = key_filter(done, ["key"], 1 << 18).first()["words"]
    assert len(words) == (1 << 18) // 64
    plan = pending(items, done, "key", expected=20_000)._jdf.queryExecution().executedPlan().toString()
    assert "getbit" in plan
    from qcorpus.sources.records import _filter_places
    held = F.lit(True)
    shared = spark.createDataFrame([(words,)], "words array<long>").scalar()
    for place in _filter_places(["key"], 1 << 18):
        held = held & (F.getbit(F.get(shared, F.shiftright(place, 6).cast("int")),
                                place.bitwiseAND(F.lit(63)).cast("int")) == 1)
    passed = items.where(held)
    assert passed.where("key < 20000").count() == 20_000
    assert passed.where("key >= 20000").count() < 900  # 3 % of the unfinished
