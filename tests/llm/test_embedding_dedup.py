import math

import numpy as np
import pytest

from qcorpus.llm import embedding_dedup as D

SCHEMA = "vec_id long, embedding array<float>, label int, node string, n_links string"


def made(n=300, dim=24, seed=2):
    rng = np.random.default_rng(seed)
    rows = []
    centres = rng.standard_normal((12, dim))
    for k in range(n):
        x = centres[rng.integers(12)] + rng.standard_normal(dim) * rng.choice([0.02, 0.25, 0.35, 1.0])
        rows.append((k, [float(np.float32(v)) for v in x], int(rng.integers(3)), "a", "b"))
    rows += [(n, rows[5][1], rows[5][2], None, None), (n + 1, [2 * v for v in rows[5][1]], rows[5][2], None, None),
             (n + 2, None, 1, None, None), (n + 3, [], 1, None, None), (n + 4, [0.0] * dim, 1, None, None),
             (n + 5, [float("nan")] * dim, 1, None, None), (n + 6, [None] + rows[5][1][1:], rows[5][2], None, None),
             (n + 7, rows[5][1], None, None, None), (n + 8, rows[5][1][:-1], rows[5][2], None, None),
             (n + 9, [float("inf")] + rows[5][1][1:], rows[5][2], None, None), (None, rows[5][1], rows[5][2], None, None),
             (5, rows[5][1], rows[5][2], None, None)]
    rows += [(n + 20 + k, rows[6][1], rows[6][2], None, None) for k in range(40)]
    return rows


def brute(rows, threshold=0.93):
    parent, links = list(range(len(rows))), [0] * len(rows)

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i
    unit = []
    for v, e, label, *_ in rows:
        x = np.array([math.nan if c is None else c for c in e], float) if e else np.zeros(0)
        ok = v is not None and label is not None and len(x) and np.isfinite(x).all() and x.any()
        unit.append(x / np.sqrt((x * x).sum()) if ok else None)
    for i in range(len(rows)):
        for j in range(i):
            if unit[i] is None or unit[j] is None or rows[i][2] != rows[j][2] or len(unit[i]) != len(unit[j]):
                continue
            if float(unit[i] @ unit[j]) >= threshold:
                links[i] += 1
                links[j] += 1
                parent[find(i)] = find(j)
    low = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            low[find(i)] = min(low.get(find(i), r[0]), r[0])
    return [(r[0], links[i], low.get(find(i)) if r[0] is not None else None) for i, r in enumerate(rows)]


@pytest.mark.parametrize("tile,recall", [(1024, 0.99), (16, 0.9999999), (5, 0.9999999)])
def test_equals_brute_force(spark, tile, recall):
    rows = made()
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = D.near_duplicates(df, tile=tile, recall=recall).collect()
    key = lambda x: (str(x[0]), x[1])
    assert sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in got), key=key) == sorted(brute(rows), key=key)
    assert all(r["kept"] == (r["vec_id"] is not None and r["vec_id"] == r["component_id"]) for r in got)


def test_recall_of_the_planned_bands(spark):
    """Pairs at and above the threshold, with bands as narrow as a large table has."""
    rng = np.random.default_rng(3)
    rows = []
    for k in range(600):
        x = rng.standard_normal(48)
        y = rng.standard_normal(48)
        y -= x * (x @ y) / (x @ x)
        a = math.acos(0.931 + 0.06 * rng.random())
        z = x / np.linalg.norm(x) * math.cos(a) + y / np.linalg.norm(y) * math.sin(a)
        rows += [(2 * k, x.tolist(), 0), (2 * k + 1, z.tolist(), 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = D.near_duplicates(df, tile=16)  # 7 bits a band
    assert got.where("n_links > 0").count() >= 0.9 * len(rows)


def test_estimate_is_unbiased_and_bounded():
    rng = np.random.default_rng(4)
    dim = 64
    x = rng.standard_normal((400, dim))
    x /= np.linalg.norm(x, axis=1)[:, None]
    y = x[:50] + 0.1 * rng.standard_normal((50, dim))
    y /= np.linalg.norm(y, axis=1)[:, None]
    errors, outside = [], 0
    for number in range(20):
        r = D.rotation(dim, 100 + number)
        code, factor = D.encode(x @ r.T)
        value, bound = D.estimate(code, factor, y @ r.T), D.error_bound(factor, dim)
        true = x @ y.T
        errors.append(value - true)
        outside += (np.abs(value - true) > bound[:, None] * np.sqrt(1 - true ** 2) + 1e-5).mean()
    assert abs(np.mean(errors)) < 0.002 and outside / 20 < 0.001


def test_rotation_is_orthogonal_and_fixed():
    r = D.rotation(20)
    assert np.allclose(r @ r.T, np.eye(20)) and np.array_equal(r, D.rotation(20))


def test_empty_table(spark):
    assert D.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []


def test_links_do_not_depend_on_the_size(spark):
    """Pairs just above the threshold, in a label of many tiles and in one tile."""
    rng = np.random.default_rng(7)
    rows = []
    for k in range(600):
        x, y = rng.standard_normal((2, 32))
        y -= x * (x @ y) / (x @ x)
        a = math.acos(0.9301)
        z = x / np.linalg.norm(x) * math.cos(a) + y / np.linalg.norm(y) * math.sin(a)
        rows += [(2 * k, x.tolist(), 0), (2 * k + 1, z.tolist(), 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    for tile in (100, 4096):
        got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in D.near_duplicates(df, tile=tile).collect()}
        assert got == {k: (1, k - k % 2) for k in range(len(rows))}


def test_certain_floor_never_passes_the_estimate():
    rng = np.random.default_rng(8)
    for dim in (2, 3, 8, 64):
        x = rng.standard_normal((300, dim))
        x /= np.linalg.norm(x, axis=1)[:, None]
        y = x + 0.3 * rng.standard_normal((300, dim)) / math.sqrt(dim)
        y /= np.linalg.norm(y, axis=1)[:, None]
        code, factor = D.encode(x)
        value = D.estimate(code, factor, y)
        assert code.shape == (300, -(-dim // 8))
        near = (x * y).sum(axis=1) >= D.THRESHOLD
        assert near.any() and (np.diag(value) >= D._certain_floor(factor, D.THRESHOLD))[near].all()
