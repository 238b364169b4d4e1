"""Connected components of an undirected link table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .scratch import stored


def connected_components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) of every node of ``links`` (a, b: long), component
    being the smallest node reachable.

    Alternating large-star and small-star steps: each node's neighbours are
    tied to the smallest node seen, which halves distances per round while
    the link count never grows.  Both steps are a min aggregation (combined
    before the shuffle) and an equi-join of links with one row per node, so a
    node with very many links is split by the skew-join rule.  Every round is
    a written table.  Loops (a = b) and null ends are ignored.  An empty
    table gives an empty result.  Raises if ``rounds`` are not enough.
    """
    edges, state = _written(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                            .distinct())
    for _ in range(rounds):
        if state[0] == 0:
            break
        both = edges.union(edges.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # large star: neighbours above u hang on the smallest node around u
        large = (both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .where("u <> v").distinct())
        # small star: u and its lower neighbours hang on the smallest of them
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low2, "u")
                 .select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
                                           F.struct("u", F.col("m").alias("v")))).alias("e"))
                 .select("e.u", "e.v").where("u <> v").distinct())
        before = state
        edges, state = _written(small)
        if state == before:
            break
    else:
        raise RuntimeError(f"components not settled after {rounds} rounds")
    roots = edges.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)


def _written(edges: DataFrame) -> tuple[DataFrame, tuple[int, int]]:
    """``edges`` as a written table, and its row count and content hash, which
    are observed while writing."""
    seen = Observation()
    table = stored(edges.observe(seen, F.count(F.lit(1)).alias("n"),
                                 F.coalesce(F.expr("bit_xor(xxhash64(u, v))"), F.lit(0)).alias("x")), "links")
    return table, (seen.get["n"], seen.get["x"])
