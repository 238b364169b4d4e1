import random

from qcorpus.llm.components import connected_components


def test_equals_union_find(spark):
    rng = random.Random(9)
    links = [(k, k + 1) for k in range(0, 60)] + [(1000, 1000 + k) for k in range(1, 50)]
    links += [(rng.randint(2000, 2100), rng.randint(2000, 2100)) for _ in range(60)] + [(7, 7), (3, None), (None, None)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x
    for a, b in links:
        if a is not None and b is not None and a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    rng.shuffle(links)
    got = connected_components(spark.createDataFrame(links, "a long, b long"))
    assert {r["node"]: r["component"] for r in got.collect()} == {n: find(n) for n in parent}
    assert got.count() == len(parent)


def test_empty(spark):
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []
