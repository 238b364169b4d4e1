"""A stored inverted-file index for approximate nearest neighbours.

``build_index`` fits spherical k-means cells on a bounded sample, assigns every
vector to its nearest cell and writes, once and independent of any query,

* ``cells``: centroid, row count and number of splits of each cell,
* ``codes/cell=...``: packed blocks of one byte per component and one scale per vector,
* ``vectors/cell=...``: the vectors themselves.

``search_index`` probes the nearest cells of each query: only their partitions
are read, query blocks meet code blocks of the same cell in tasks, the best
``rerank`` x k per query by code are compared exactly and the best k stay.

A cell of many rows is written and searched in several splits, so a cell that holds
a third of all vectors is the work of many tasks.  The cell table is the only thing
that travels to every task; it has at most ``MAX_CELLS`` rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from qcorpus.operators.blocks import BLOCK_ROWS, packed, top_pairs, unit_rows
from qcorpus.operators.vectors import centroids, dot, l2_normalize

MAX_CELLS = 65_536
SAMPLE_BYTES = 64 << 20  # bound on the sample that the cells are fitted on
SPLIT_ROWS = 64 * BLOCK_ROWS


def _nearest(spark: SparkSession, centers: np.ndarray, n: int):
    """UDF: the ``n`` nearest cells of a vector, nearest first, ties by number."""
    matrix = spark.sparkContext.broadcast(centers)  # at most MAX_CELLS rows
    dim = centers.shape[1]

    @F.arrow_udf("array<int>")
    def cells(vectors: pa.Array) -> pa.Array:
        rows, x = unit_rows(vectors, dim)
        out: list[list[int] | None] = [None] * len(vectors)
        for lo in range(0, len(rows), 512):
            sims = x[lo:lo + 512] @ matrix.value.T
            for r, near in zip(rows[lo:lo + 512], np.argsort(-sims, axis=1, kind="stable")[:, :n]):
                out[r] = near.tolist()
        return pa.array(out, pa.list_(pa.int32()))

    return cells


def fit_cells(vectors: DataFrame, n_cells: int, dim: int, iterations: int = 2, id_col: str = "id",
              vec_col: str = "embedding") -> np.ndarray:
    """Unit centroids of ``n_cells`` cells: spherical k-means on the rows with the
    smallest MD5 of their id, as many as ``SAMPLE_BYTES`` allow, begun at the first
    of them.  Assignments and means run in tasks; the centroids come back."""
    spark = vectors.sparkSession
    most = max(n_cells, SAMPLE_BYTES // (8 * dim))
    good = vectors.where((F.size(vec_col) == dim) & F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("id"), l2_normalize(vec_col).alias("embedding"))
    order = [F.md5(F.col("id").cast("string")), F.col("id")]
    sample = good.orderBy(*order).limit(most)
    seeds = [r["embedding"] for r in sample.orderBy(*order).limit(n_cells).select("embedding").collect()]
    centers = np.array(seeds, np.float64).reshape(-1, dim)
    for _ in range(iterations):
        cell = _nearest(spark, centers, 1)("embedding")[0].alias("cell")
        means = centroids(sample.select(cell, "embedding").where("cell is not null"), "cell").collect()
        for r in means:
            mean = np.array(r["centroid"])
            norm = np.linalg.norm(mean)
            if norm > 0:
                centers[r["cell"]] = mean / norm
    return centers


def build_index(vectors: DataFrame, path: str, n_cells: int | None = None, iterations: int = 2, id_col: str = "id",
                vec_col: str = "embedding", split_rows: int = SPLIT_ROWS) -> int:
    """Writes the index of all vectors that have an id and ``dim`` finite
    components, dim being the most frequent size; returns the number of cells
    (default: the root of the number of vectors).  An empty table gives an
    index without cells."""
    spark = vectors.sparkSession
    v = vectors.where(F.col(id_col).isNotNull() & (F.size(vec_col) > 0)).select(
        F.col(id_col).alias("id"), F.col(vec_col).alias("embedding"))
    stats = v.agg(F.count("*").alias("n"), F.mode(F.size("embedding")).alias("dim")).first()
    if not stats["n"]:
        spark.createDataFrame([], "cell int, centroid array<double>, rows bigint, splits int").write.parquet(f"{path}/cells")
        return 0
    n_cells = min(n_cells or round(stats["n"] ** 0.5), MAX_CELLS)
    centers = fit_cells(v, n_cells, stats["dim"], iterations)
    near = v.select(_nearest(spark, centers, 1)("embedding")[0].alias("cell"), "id", "embedding").where("cell is not null")
    near.write.parquet(f"{path}/assigned")
    near = spark.read.parquet(f"{path}/assigned")
    rows = near.groupBy("cell").agg(F.count("*").alias("rows"))
    table = spark.createDataFrame([(k, c.tolist()) for k, c in enumerate(centers)], "cell int, centroid array<double>")
    cells = table.join(rows, "cell", "left").select(
        "cell", "centroid", F.coalesce("rows", F.lit(0)).alias("rows"),
        F.ceil(F.coalesce("rows", F.lit(0)) / split_rows).cast("int").alias("splits"))
    cells.write.parquet(f"{path}/cells")
    cells = spark.read.parquet(f"{path}/cells")
    split = F.pmod(F.xxhash64("id"), F.col("splits")).cast("int").alias("split")
    dealt = (near.join(F.broadcast(cells.select("cell", "splits")), "cell").select("cell", split, "id", "embedding")
             .repartition("cell", "split").sortWithinPartitions("cell", "split"))
    dealt.write.partitionBy("cell").parquet(f"{path}/vectors")
    stored = spark.read.schema(dealt.schema).parquet(f"{path}/vectors")
    codes = packed(stored, ["cell", "split"], "id", "embedding", stats["dim"], code=True)
    codes.write.partitionBy("cell").parquet(f"{path}/codes")
    return len(centers)


def search_index(path: str, queries: DataFrame, k: int = 3, probes: int | float = 0.1, rerank: int = 8,
                 query_id: str = "query_id", query_vec: str = "embedding", exclude_self: bool = False) -> DataFrame:
    """(query_id, id, similarity, rank): approximate top k by cosine similarity,
    ties by id, from the index in ``path``.  ``probes``: cells per query, or a share
    of all cells (below 1); ``rerank`` x k hits by code are compared exactly."""
    spark = queries.sparkSession
    cells = spark.read.parquet(f"{path}/cells")
    table = cells.orderBy("cell").collect()  # at most MAX_CELLS rows
    id_type = queries.schema[query_id].dataType.simpleString()
    if not table:
        return spark.createDataFrame([], f"query_id {id_type}, id {id_type}, similarity double, rank int")
    centers = np.array([r["centroid"] for r in table])
    n = max(1, round(probes * len(centers))) if probes < 1 else min(int(probes), len(centers))
    q = queries.select(F.col(query_id).alias("query_id"), F.col(query_vec).alias("embedding"))
    near = q.select("query_id", "embedding", F.explode(_nearest(spark, centers, n)("embedding")).alias("cell"))
    wide = near.join(F.broadcast(cells.where("splits > 0").select("cell", "splits")), "cell")
    # about BLOCK_ROWS queries of a cell form a block, whatever the number of queries
    deal = F.pmod(F.xxhash64("query_id"), F.lit(max(1, -(-q.count() // BLOCK_ROWS)))).alias("deal")
    blocks = packed(wide.select("cell", "splits", deal, "query_id", "embedding").repartition("cell", "deal"),
                    ["cell", "splits", "deal"], "query_id", "embedding", centers.shape[1])
    blocks = blocks.withColumn("split", F.explode(F.sequence(F.lit(0), F.col("splits") - 1)))
    codes, vectors = (spark.read.parquet(f"{path}/{name}") for name in ("codes", "vectors"))
    probed = [r["cell"] for r in near.select("cell").distinct().collect()] if n < len(centers) else None
    if probed is not None and len(probed) < len(centers):
        codes, vectors = (d.where(F.col("cell").isin(probed)) for d in (codes, vectors))
    found = top_pairs(blocks, codes, ["cell", "split"], centers.shape[1], rerank * k, exclude_self)
    exact = (found.select("query_id", "id").distinct().join(vectors.select("id", F.col("embedding").alias("v")), "id")
             .join(q.select("query_id", F.col("embedding").alias("q")), "query_id")
             .select("query_id", "id", dot(l2_normalize("q"), l2_normalize("v")).alias("similarity")))
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id")
    return exact.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
