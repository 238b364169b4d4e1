"""Vector collection operators.

Exact nearest neighbours compare blocks of queries with blocks of vectors
(``blocks.py``): blocks meet in tasks by an equi-join on a grid, each task keeps the
best k per query, and one window merges them.  No pair table is materialised
and no query passes through the driver.  ``vector_index.py`` holds the
approximate search (C9).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from qcorpus.operators.blocks import packed, top_pairs
from qcorpus.operators.ranking import batch_id as _batch_id
from qcorpus.operators.ranking import global_row_number

QUERY_BLOCK_BYTES = 16 << 20


def _col(c):
    return F.col(c) if isinstance(c, str) else c


def l2_normalize(v: Column | str) -> Column:
    """Unit-length vector computed in double; a zero vector is unchanged."""
    v = _col(v)
    norm = F.sqrt(F.aggregate(v, F.lit(0.0).cast("double"), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.when(norm > 0, F.transform(v, lambda x: x.cast("double") / norm)) \
            .otherwise(F.transform(v, lambda x: x.cast("double")))


def dot(a: Column | str, b: Column | str) -> Column:
    """Dot product of two numeric arrays, in double."""
    return F.aggregate(F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") * y.cast("double")),
                       F.lit(0.0).cast("double"), lambda acc, x: acc + x)


def centroids(vectors: DataFrame, group_col: str, vec_col: str = "embedding") -> DataFrame:
    """Mean vector per group (partial aggregation per task, then merge):
    ``group_col, centroid ARRAY<DOUBLE>``."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer
    v = vectors.select(group_col, array_to_vector(F.col(vec_col)).alias("__v"))
    return v.groupBy(group_col).agg(Summarizer.mean(F.col("__v")).alias("__m")) \
            .select(group_col, vector_to_array("__m").alias("centroid"))


def top_k_similar(queries: DataFrame, vectors: DataFrame, k: int = 3, query_id: str = "query_id",
                  query_vec: str = "embedding", id_col: str = "id", vec_col: str = "embedding",
                  exclude_self: bool = False, query_block_bytes: int = QUERY_BLOCK_BYTES) -> DataFrame:
    """C8 + E8: exact top-k stored vectors per query by cosine similarity, ties by id;
    ``similarity = 1 - distance``.  Returns ``query_id, <id>, similarity, rank,
    distance``.

    Queries form blocks of about ``query_block_bytes``.  A grid of block numbers
    and vector groups deals the work: a vector block goes to every query block
    once, a query block to every group, so there are about three tasks per core however
    many queries or vectors there are.  Queries and vectors that are null, not
    finite, without an id or of another size than the most frequent one meet nothing."""
    q = queries.select(F.col(query_id).alias("query_id"), F.col(query_vec).alias("embedding"))
    stats = q.agg(F.count("*").alias("n"), F.mode(F.when(F.size("embedding") > 0, F.size("embedding"))).alias("dim")).first()
    dim = stats["dim"] or 1
    n_blocks = max(1, -(-stats["n"] * dim * 8 // query_block_bytes))
    rows = max(1, query_block_bytes // (8 * dim))
    groups = max(1, -(-3 * queries.sparkSession.sparkContext.defaultParallelism // n_blocks))
    dealt = q.withColumn("c", F.pmod(F.xxhash64("query_id"), F.lit(n_blocks)).cast("int"))
    dealt = dealt.repartition("c") if n_blocks > 1 else dealt
    qb = packed(dealt, ["c"], "query_id", "embedding", dim, rows)
    qb = qb.withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    vb = packed(vectors.withColumn("__all", F.lit(0)), ["__all"], id_col, vec_col, dim)
    vb = vb.withColumn("r", F.pmod(F.xxhash64("ids"), F.lit(groups)).cast("int")) \
        .withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    hits = top_pairs(qb, vb, ["r", "c"], dim, k, exclude_self)
    return hits.select("query_id", F.col("id").alias(id_col), "similarity", "rank",
                       (F.lit(1.0) - F.col("similarity")).alias("distance"))


def retrieve_examples(hits: DataFrame, metadata: DataFrame, queries: DataFrame, id_col: str = "id",
                      query_id: str = "query_id") -> DataFrame:
    """Per query, the retrieved examples as a text block: repeated
    ``source_id`` dropped (best rank kept), hits with empty question or SQL
    dropped, ``-- Example Question: q`` / ``-- Example SQL: s`` pairs in rank
    order separated by a blank line; ``(No similar examples found)`` for
    queries without any.  Groups are bounded by k per query."""
    h = hits.join(metadata, id_col, "inner")
    w = Window.partitionBy(query_id, "source_id").orderBy("rank")
    h = h.withColumn("__first", F.row_number().over(w)).filter(F.col("__first") == 1)
    h = h.filter((F.coalesce(F.col("question"), F.lit("")) != "") & (F.coalesce(F.col("sql"), F.lit("")) != ""))
    block = F.concat(F.lit("-- Example Question: "), F.col("question"), F.lit("\n-- Example SQL: "), F.col("sql"))
    g = h.groupBy(query_id).agg(F.sort_array(F.collect_list(F.struct("rank", block.alias("b")))).alias("bs"))
    g = g.select(query_id, F.array_join(F.transform("bs", lambda x: x["b"]), "\n\n").alias("examples"),
                 F.size("bs").alias("n_examples"))
    return queries.select(query_id).join(g, query_id, "left").select(
        query_id, F.coalesce("examples", F.lit("(No similar examples found)")).alias("examples"),
        F.coalesce("n_examples", F.lit(0)).cast("bigint").alias("n_examples"))


def batch_ids(vectors: DataFrame, order_col: str, batch_size: int = 512) -> DataFrame:
    """Fixed-size batches in ``order_col`` order (no single-partition window)."""
    return global_row_number(vectors, order_col, "__rn").withColumn("batch_id", _batch_id(F.col("__rn"), batch_size)) \
        .drop("__rn")


def hashing_encoder(num_features: int = 1024):
    """I2 default encoder for users without a model: token hashing (JVM
    ``HashingTF`` over lower-cased word tokens) and L2 normalisation."""
    from pyspark.ml.feature import HashingTF, Normalizer, RegexTokenizer
    from pyspark.ml.functions import vector_to_array

    def encode(df: DataFrame, text_col: str, out_col: str = "embedding") -> DataFrame:
        # Unicode-aware word split: accented letters stay inside their words
        tok = RegexTokenizer(inputCol=text_col, outputCol="__tok", pattern=r"(?U)\W+", toLowercase=True)
        tf = HashingTF(inputCol="__tok", outputCol="__tf", numFeatures=num_features)
        norm = Normalizer(inputCol="__tf", outputCol="__n", p=2.0)
        out = norm.transform(tf.transform(tok.transform(df)))
        return out.withColumn(out_col, vector_to_array("__n", "float32")).drop("__tok", "__tf", "__n")
    return encode


def batch_embed(df: DataFrame, text_col: str, encoder=None, out_col: str = "embedding",
                batch_size: int = 64) -> DataFrame:
    """Embeddings of ``text_col``.  ``encoder`` is either None (hashing
    default, JVM-side) or a factory returning ``f(list[str]) -> 2-D array``
    that is loaded once per task and fed Arrow batches (Iterator pandas UDF)."""
    if encoder is None:
        return hashing_encoder()(df, text_col, out_col)
    @F.pandas_udf("array<float>")
    def embed(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = encoder()
        for s in it:
            outs = []
            vals = s.fillna("").tolist()
            for i in range(0, len(vals), batch_size):
                outs.extend([list(map(float, r)) for r in model(vals[i:i + batch_size])])
            yield pd.Series(outs)
    return df.withColumn(out_col, embed(F.col(text_col)))


def verify_count(written: DataFrame, expected: int) -> int:
    """Stored row count must equal the expected count."""
    n = written.count()
    if n != expected:
        raise ValueError(f"vector count mismatch: stored {n}, expected {expected}")
    return n
