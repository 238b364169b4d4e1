"""The first rows of each group against sorting them."""

import random
from collections import defaultdict

import pytest

from qcorpus.operators.ranking import first_rows


@pytest.mark.parametrize("span,buckets", [(400, 7), (10 ** 12, 7), (400, 1)])
def test_first_rows_equal_sorting(spark, span, buckets):
    rng = random.Random(span)
    keys = rng.sample(range(span), 300)
    rows = [(rng.choice(["a", "a", "a", "b", "c"]), k) for k in keys] + [("a", None)]
    limits = {"a": 90, "b": 0, "c": 1000, "none": 5}
    df = spark.createDataFrame(rows, "class string, id long").repartition(4)
    out = first_rows(df, "class", "id", spark.createDataFrame(list(limits.items()), "class string, quota long"), "rank", buckets)
    groups = defaultdict(list)
    for g, k in rows:
        groups[g].append(k)
    want = {(g, k, n + 1) for g, ks in groups.items()
            for n, k in enumerate(sorted(ks, key=lambda k: (k is not None, k or 0))[:limits.get(g, 0)])}
    assert {(r["class"], r["id"], r["rank"]) for r in out.collect()} == want


def test_empty_table(spark):
    none = spark.createDataFrame([], "class string, id long")
    assert first_rows(none, "class", "id", spark.createDataFrame([("a", 5)], "class string, quota long")).collect() == []
