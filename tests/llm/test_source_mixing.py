import math
from collections import defaultdict

import pytest

from qcorpus.llm import source_mixing as M
from tests.llm.fixtures import docs, no_docs


def test_targets_by_hand():
    assert M.targets([100, 100, 100]) == [200.0, 250 / 3 * 2, 250 / 3]
    assert M.targets([]) == [] and M.targets([0, 0]) == [0.0, 0.0]
    assert M.targets([7]) == [10.5]


@pytest.mark.parametrize("sizes", [[10, 500, 30, 1, 90, 4000], [1000, 1, 1], [5, 5, 5, 5, 5, 5, 5, 5]])
def test_targets_share_all_words(sizes):
    got = M.targets(sizes)
    assert math.isclose(sum(got), 1.5 * sum(sizes)) and all(g <= 2 * s + 1e-9 for g, s in zip(got, sizes))
    units = [g / M.WEIGHTS[i % 3] for i, g in enumerate(got) if g < 2 * sizes[i] - 1e-9]
    assert max(units, default=0) - min(units, default=0) < 1e-6


@pytest.mark.parametrize("goals,block", [([5000, 30, 0, 777777], 10), ([1], 5), ([0, 0], 5), ([70000 * 3, 70000], 1)])
def test_schedule_gives_every_source_its_blocks(spark, goals, block):
    ranks = defaultdict(list)
    slots = M.schedule(spark, goals, block).collect()
    for r in slots:
        ranks[r["source_no"]].append(r["rank"])
    for k, g in enumerate(goals):
        assert sorted(ranks[k]) == list(range(math.ceil(g / block)))
    # a source's slots come at their share of the sequence, within a few
    need = [math.ceil(g / block) for g in goals]
    total = sum(need)
    for r in slots:
        if r["slot"] < total:
            assert abs(r["rank"] - r["slot"] * need[r["source_no"]] / total) < 4 + 2 * math.log2(total + 1)


def test_takes_targets_evenly(spark):
    df = docs(spark)
    out = M.mix_sources(df, ["doc_id", "source"], block=16).collect()
    assert len(out) == df.count()
    by = defaultdict(list)
    for r in out:
        assert 0 <= r["taken"] <= 2 * r["size"] and r["taken"] == sum(p["words"] for p in r["parts"])
        by[r["source"]].append(r)
    sizes = [sum(r["size"] for r in by[s]) for s in ("a", "b", "c", None)]
    for s, size, goal in zip(("a", "b", "c", None), sizes, M.targets(sizes)):
        assert {r["source_size"] for r in by[s]} == {size} and {r["target"] for r in by[s]} == {goal}
        assert sum(r["taken"] for r in by[s]) == math.floor(goal)


def test_any_prefix_of_the_mix_holds_the_shares(spark):
    """Taken words in the order of the slots: at every point a source is near its share."""
    rows = [(k, "ab"[k % 7 // 5] if k % 11 else None, " ".join(["w"] * (20 + k % 50))) for k in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    out = M.mix_sources(df, ["doc_id", "source"], block=32).collect()
    took = sorted((p["slot"], r["source"] or "", p["words"]) for r in out for p in r["parts"])
    assert all((r["first_slot"] is None) == (r["taken"] == 0) for r in out)
    total, goal = sum(w for *_, w in took), defaultdict(int)
    for _, s, w in took:
        goal[s] += w
    sofar, n = defaultdict(int), 0
    for _, s, w in took:
        sofar[s] += w
        n += w
        assert all(abs(sofar[x] - n * goal[x] / total) < 0.01 * total for x in goal)


def test_reruns_and_layouts_agree(spark):
    key = lambda r: str(r)
    a = sorted(M.mix_sources(docs(spark), ["doc_id"], block=7).collect(), key=key)
    b = sorted(M.mix_sources(docs(spark).repartition(2, "lang"), ["doc_id"], block=7).collect(), key=key)
    assert a == b


def test_columns(spark):
    df = docs(spark).withColumnRenamed("score", "size")
    out = M.mix_sources(df)
    assert out.columns.count("size") == 1 and set(df.columns) - {"size"} <= set(out.columns)


def test_empty_table(spark):
    assert M.mix_sources(no_docs(spark)).collect() == []
