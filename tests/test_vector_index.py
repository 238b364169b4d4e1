"""Block search and the stored inverted-file index."""

import glob
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from qcorpus.operators import blocks as B
from qcorpus.operators import vector_index as X
from qcorpus.operators import vectors as V
from qcorpus.plans import fixtures
from qcorpus.plans.eval_queries import PROBES
from tests.conftest import SF_ORACLE


def asked(vec):
    return vec.where("id % 20 = 0").select(F.col("id").alias("query_id"), "embedding")


def hits(df):
    return {(r["query_id"], r["id"]): r["similarity"] for r in df.collect()}


def clustered(spark, n=3000, groups=30, dim=16, seed=3):
    rng = np.random.default_rng(seed)
    centers = rng.standard_normal((groups, dim)) * 4
    rows = [(i, (centers[rng.integers(groups)] + rng.standard_normal(dim)).tolist()) for i in range(n)]
    return spark.createDataFrame(rows, "id long, embedding array<double>").repartition(4), rows


def test_recall_on_the_given_vectors(spark, tmpdir_path):
    """All ids divisible by 20, the vector itself left out; under 20 % of all
    pairs are compared exactly."""
    vec = fixtures.vectors(spark.read.parquet(f"{SF_ORACLE}/embeddings.parquet"))
    X.build_index(vec, f"{tmpdir_path}/i")
    want = hits(V.top_k_similar(asked(vec), vec, k=3, exclude_self=True))
    near = hits(X.search_index(f"{tmpdir_path}/i", asked(vec), k=3, probes=PROBES, exclude_self=True))
    assert sum(p in near for p in want) >= 0.9 * len(want)
    assert all(abs(near[p] - want[p]) < 1e-9 for p in want if p in near)
    assert 3 * 8 < 0.2 * vec.count()


def test_few_probes_suffice_where_vectors_cluster(spark, tmpdir_path):
    vec, rows = clustered(spark)
    X.build_index(vec, f"{tmpdir_path}/i")
    want = hits(V.top_k_similar(asked(vec), vec, k=3, exclude_self=True))
    near = hits(X.search_index(f"{tmpdir_path}/i", asked(vec), k=3, probes=0.1, exclude_self=True))
    assert sum(p in near for p in want) >= 0.9 * len(want)


def test_only_probed_partitions_are_read(spark, tmpdir_path):
    vec, rows = clustered(spark)
    n = X.build_index(vec, f"{tmpdir_path}/i", n_cells=20)
    assert n == 20
    one = vec.where("id = 5").select(F.col("id").alias("query_id"), "embedding")
    plan = X.search_index(f"{tmpdir_path}/i", one, k=3, probes=2)._jdf.queryExecution().executedPlan().toString()
    cells = {os.path.basename(p) for p in glob.glob(f"{tmpdir_path}/i/codes/cell=*")}
    assert len(cells) > 10 and plan.count("PartitionFilters: [isnotnull(cell#") + plan.count("PartitionFilters: [cell#") >= 2


def test_index_is_whole_and_hot_cells_are_split(spark, tmpdir_path):
    vec, rows = clustered(spark, n=1200)
    copies = spark.createDataFrame([(10_000 + i, rows[0][1]) for i in range(900)], vec.schema)
    both = vec.unionByName(copies)
    X.build_index(both, f"{tmpdir_path}/i", split_rows=100)
    stored = spark.read.parquet(f"{tmpdir_path}/i/vectors")
    assert stored.count() == stored.select("id").distinct().count() == 2100
    codes = spark.read.parquet(f"{tmpdir_path}/i/codes")
    assert codes.agg(F.sum("n")).first()[0] == 2100
    cells = spark.read.parquet(f"{tmpdir_path}/i/cells")
    assert cells.agg(F.sum("rows"), F.max("splits")).first()[0] == 2100 and cells.agg(F.max("splits")).first()[0] >= 9
    one = spark.createDataFrame([(1, rows[0][1])], "query_id long, embedding array<double>")
    got = X.search_index(f"{tmpdir_path}/i", one, k=5, probes=3, rerank=400)
    assert [r["id"] for r in got.orderBy("rank").collect()] == [rows[0][0], 10_000, 10_001, 10_002, 10_003]


def test_all_probes_are_exact(spark, tmpdir_path):
    vec, rows = clustered(spark, n=400)
    X.build_index(vec, f"{tmpdir_path}/i")
    q = asked(vec)
    assert set(hits(X.search_index(f"{tmpdir_path}/i", q, k=4, probes=10_000))) == set(hits(V.top_k_similar(q, vec, k=4)))


ODD = [(1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [1.0]), (6, []), (None, [1.0, 1.0]), (7, [0.0, 2.0]),
       (7, [0.0, 2.0]), (8, [float("inf"), 0.0]), (9, [1.0, None])]


@pytest.mark.parametrize("kind", ["long", "string"])
def test_odd_vectors(spark, tmpdir_path, kind):
    df = spark.createDataFrame(ODD, "id long, embedding array<double>").select(F.col("id").cast(kind).alias("id"), "embedding")
    q = df.select(F.col("id").alias("query_id"), "embedding")
    got = hits(V.top_k_similar(q, df, k=9))
    assert {int(a) for a, _ in got} == {1, 3, 7} and {int(b) for _, b in got} == {1, 3, 7}
    assert got[tuple(map(type(next(iter(got))[0]), (1, 7)))] == 0
    X.build_index(df, f"{tmpdir_path}/i")
    assert set(hits(X.search_index(f"{tmpdir_path}/i", q, k=9, probes=99))) == set(got)


def test_empty_tables(spark, tmpdir_path):
    none = spark.createDataFrame([], "id long, embedding array<double>")
    some = spark.createDataFrame([(1, [1.0, 0.0])], "id long, embedding array<double>")
    q = none.select(F.col("id").alias("query_id"), "embedding")
    assert V.top_k_similar(q, some).collect() == [] and V.top_k_similar(some.withColumnRenamed("id", "query_id"), none).collect() == []
    assert X.build_index(none, f"{tmpdir_path}/i") == 0
    assert X.search_index(f"{tmpdir_path}/i", some.withColumnRenamed("id", "query_id")).collect() == []


def test_blocks_hold_every_row_once(spark):
    df = spark.range(1000).select((F.col("id") % 7).alias("c"), "id", F.array(F.col("id") + 1.0, F.lit(1.0)).alias("v")).repartition(3)
    out = B.packed(df, ["c"], "id", "v", 2, rows=16).collect()
    assert sorted(i for r in out for i in r["ids"]) == list(range(1000)) and all(len(r["ids"]) == r["n"] <= 16 for r in out)
    assert all(i % 7 == r["c"] for r in out for i in r["ids"])
