import re
from collections import Counter

import numpy as np
import pytest

from qcorpus.llm import ngram_jaccard as J
from tests.llm.fixtures import docs, no_docs
from tests.conftest import SF_SMALL

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(text):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w)} if 0 < len(w) < 4 else {tuple(w[i:i + 4]) for i in range(len(w) - 3)}


def brute(rows, num=85, den=100):
    """(doc_id, n_shingles, component_id) per row, by comparing all pairs."""
    sets = [shingle_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for i in range(len(rows)):
        for j in range(i):
            if rows[i][0] is None or rows[j][0] is None or not sets[i] or not sets[j]:
                continue
            common = len(sets[i] & sets[j])
            if den * common >= num * (len(sets[i]) + len(sets[j]) - common):
                parent[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            r = find(i)
            low[r] = min(low.get(r, d), d)
    return Counter((d, len(sets[i]), low.get(find(i)) if d is not None else None) for i, (d, _) in enumerate(rows))


def found(df):
    return Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in df.collect())


def test_equals_brute_force(spark):
    df = docs(spark)
    assert found(J.ngram_jaccard_components(df)) == brute([(r["doc_id"], r["text"]) for r in df.collect()])


@pytest.mark.parametrize("threshold,num", [(0.8, 80), (0.6, 60)])
def test_other_thresholds_and_tiny_tiles(spark, threshold, num):
    df = docs(spark, seed=3)
    got = found(J.ngram_jaccard_components(df, threshold=threshold, tile=3))
    assert got == brute([(r["doc_id"], r["text"]) for r in df.collect()], num)


def test_chain_of_near_copies(spark):
    base = [f"w{i}" for i in range(120)]
    rows = [(k, " ".join(base[:3 * k] + [f"n{i}" for i in range(3 * k)] + base[6 * k:])) for k in range(15)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(J.ngram_jaccard_components(df, tile=2)) == brute(rows)


def test_empty_table(spark):
    assert J.ngram_jaccard_components(no_docs(spark)).collect() == []


def test_one_document_of_each_component_stays(spark):
    df = docs(spark)
    rows = df.collect()
    kept = J.drop_linked(df).collect()
    part = brute([(r["doc_id"], r["text"]) for r in rows])
    want = Counter(d for d, n, c in part if d is not None and (n == 0 or c == d))
    assert Counter(r["doc_id"] for r in kept if r["doc_id"] is not None) == want
    assert sum(r["doc_id"] is None for r in kept) == sum(r["doc_id"] is None for r in rows)
    assert kept[0].asDict().keys() == rows[0].asDict().keys()


def test_equals_brute_force_on_the_given_table(spark):
    df = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    assert found(J.ngram_jaccard_components(df)) == brute([(r["doc_id"], r["text"]) for r in df.collect()])


def test_every_pair_within_the_bound_shares_a_key():
    rng = np.random.default_rng(5)
    t = J.percent(0.85)
    ends = J.bands(400, t)
    for _ in range(300):
        n = int(rng.integers(7, 300))
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64) * np.uint64(2))
        gone = int(rng.integers(0, max(1, n // 10) + 1))
        b = np.unique(np.concatenate([rng.permutation(a)[gone:], rng.integers(0, 2**63, gone).astype(np.uint64)]))
        common = len(np.intersect1d(a, b))
        if common / (len(a) + len(b) - common) < 0.85 or not len(b):
            continue
        s = int(np.searchsorted(ends, max(len(a), len(b)), side="right")) - 1
        h = J.difference_bound(2 * (ends[s + 1] - 1), t)
        for twos in {0, h // 4, h // 2}:
            keys = [set(J.segment_keys(x, s, h + 1 - twos, twos).tolist()) for x in (a, b)]
            assert keys[0] & keys[1]


def test_sketch_never_exceeds_the_difference():
    rng = np.random.default_rng(6)
    for n in (5, 600, 3000):
        a, b = (np.unique(rng.integers(0, 2**63, n).astype(np.uint64)) for _ in range(2))
        b = np.unique(np.concatenate([a[: n // 2], b]))
        rows = J.sketch_rows([J.sketch(a), J.sketch(b)])
        assert int(np.bitwise_count(rows[0] ^ rows[1]).sum()) <= len(np.setxor1d(a, b))
