"""Embedding near-duplicates by randomised-rotation binary codes.

Every unit vector o is rotated by a random orthogonal matrix; its code is the
sign of each coordinate (a bit), which stands for the corner o_bar (coordinates
+-1/sqrt(d)) of a cube.  Code and correction factor f = <o_bar, o> are made once
per distinct vector and stored with it.  A tile reads the codes of one side,
turns the corners back by the inverse rotation and multiplies them with the
vectors of the other side: <o_bar, q> / f is an unbiased estimate of <o, q>.

Its confidence bound at ``SIGMAS`` standard errors would lose a few pairs in a
million, so by default the bound is the one that cannot fail: two vectors at an
angle of at most t have <o_bar, q> >= cos(t + acos(f)), as angles obey the
triangle inequality.  Pairs whose estimate is below the bound are ruled out, the
others recomputed in double precision.

Every pair of a label and dimension is compared, in square tiles of about
``TILE`` vectors a side, so a result does not depend on the size of the table.

By choice (``recall``), candidates are only the rows that share a *band*: the
signs along a few further random directions.  With several independent tables of
bands a pair at the threshold shares at least one with probability ``recall``
(closer pairs with more).  The width of a band follows the size of the largest
label, so bands hold about ``TILE`` vectors; bands of any size are compared
whole, and a pair is counted in the first table that it shares.  Also by choice
(``sigmas``), <o_bar, q> / f serves as an estimate of <o, q>, whose error stays
within ``sigmas`` * sqrt((1 - f^2) / f^2) / sqrt(d - 1) * sqrt(1 - <o, q>^2) but
with a small chance.

Equal vectors are one node with a multiplicity, so copies cost nothing, and a
tile gives one row per node (links counted, one link of a spanning forest)
instead of its pairs.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel
from .components import connected_components
from .scratch import stored

THRESHOLD = 0.93
SIGMAS = 4.0  # a value for ``sigmas``
TILE = 1024
SEED = 20


def rotation(dim: int, number: int = 0) -> np.ndarray:
    """A random orthogonal matrix, the same wherever it is built."""
    rng = np.random.default_rng([SEED, dim, number])
    q, r = np.linalg.qr(rng.standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def plan_bands(largest: int, threshold: float, recall: float, tile: int = TILE) -> tuple[int, int]:
    """(bits per band, tables): ``largest`` vectors fall into bands of about
    ``tile``; a pair at the threshold shares a band with probability
    ``recall``."""
    bits = max(0, min(30, math.ceil(math.log2(max(largest, 1) / tile))))
    if bits == 0:
        return 0, 1
    same = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(1 - recall) / math.log(1 - same))


def _vector_rows(batches):
    """(vec_id, label, dim, node, vector): unit vectors as bytes; null where a
    vector cannot link."""
    for batch in batches:
        vectors, dims, nodes, labels = [], [], [], batch.column("label")
        for k, v in enumerate(batch.column("embedding")):
            x = np.array(v.as_py(), dtype=np.float64) if v.is_valid else np.zeros(0)
            norm = 0.0
            if len(x) and np.isfinite(x).all():
                top = np.abs(x).max()
                norm = math.sqrt(float(((x / top) ** 2).sum())) if top > 0 else 0.0
            if norm == 0.0 or not labels[k].is_valid:
                vectors.append(None), dims.append(None), nodes.append(None)
                continue
            unit = x / top / norm + 0.0
            data = unit.tobytes()
            vectors.append(data), dims.append(len(x))
            words = np.frombuffer(data, np.uint64)
            place = np.arange(len(words) + 1, dtype=np.uint64)
            nodes.append(kernel.set_id(kernel.mix(np.append(words, np.uint64(labels[k].as_py() % (1 << 63)))
                                                  + place * np.uint64(0x9E3779B97F4A7C15))))
        yield pa.RecordBatch.from_pydict({
            "vec_id": batch.column("vec_id"), "label": batch.column("label"), "dim": pa.array(dims, pa.int32()),
            "node": pa.array(nodes, pa.int64()), "vector": pa.array(vectors, pa.binary())})


def _banded_rows(batches, bits: int, tables: int, tiles: int | None = None):
    """Per node and table: (label, dim, band, node, weight, vector, code, factor,
    bands)."""
    for batch in batches:
        dims = batch.column("dim").to_numpy(zero_copy_only=False)
        for dim in np.unique(dims):
            part = batch.filter(pa.array(dims == dim))
            n = part.num_rows
            x = np.frombuffer(b"".join(part.column("vector").to_pylist()), np.float64).reshape(n, dim)
            bands = np.zeros((n, tables), np.int32)
            if bits:
                need = bits * tables
                turned = np.concatenate([x @ rotation(int(dim), 1 + k).T for k in range(-(-need // int(dim)))], axis=1)
                sign = (turned[:, :need] > 0).reshape(n, tables, bits)
                bands = (sign << np.arange(bits)).sum(axis=2).astype(np.int32)
            packed = [row.tobytes() for row in bands]
            code, factor = encode(x)
            codes = pa.array([row.tobytes() for row in code], pa.binary())
            for t in range(tables):
                yield pa.RecordBatch.from_arrays(
                    [part.column("label"), part.column("dim"), pa.array(np.full(n, t, np.int32)), pa.array(bands[:, t]),
                     part.column("node"), part.column("weight"), part.column("vector"), codes, pa.array(factor),
                     pa.array(packed, pa.binary())],
                    names=["label", "dim", "t", "band", "node", "weight", "vector", "code", "factor", "bands"])


def encode(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes as packed bits, correction factors) of unit vectors, a row each."""
    turned = x @ rotation(x.shape[1]).T
    return np.packbits(turned > 0, axis=1), np.abs(turned).sum(axis=1) / math.sqrt(x.shape[1])


def estimate(code: np.ndarray, factor: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Unbiased estimates of the inner products of the coded vectors with the
    unit vectors ``others`` (neither side rotated by the caller)."""
    dim = others.shape[1]
    corner = np.unpackbits(code, axis=1, count=dim).astype(np.float32) * 2 - 1
    back = (corner @ rotation(dim)) / (math.sqrt(dim) * factor[:, None])
    return back.astype(np.float32) @ others.T.astype(np.float32)


def error_bound(factor: np.ndarray, dim: int, sigmas: float = SIGMAS) -> np.ndarray:
    """The estimate's error stays within this times sqrt(1 - <o, q>^2) but with a
    chance that ``sigmas`` sets."""
    return sigmas * np.sqrt(np.maximum(1 - factor ** 2, 0)) / factor / math.sqrt(max(dim - 1, 1))


def _certain_floor(factor: np.ndarray, threshold: float) -> np.ndarray:
    """The least estimate that a pair at the threshold can have."""
    angle = np.arccos(np.minimum(factor, 1)) + math.acos(max(-1.0, min(1.0, threshold)))
    return np.cos(np.minimum(angle, math.pi)) / factor - 1e-4


def _tile_links(key, pdf, threshold: float, sigmas: float | None):
    """Per node of a tile: (node, n_links in this tile, a node of its
    component in this tile)."""
    import pandas as pd
    dim, table = int(key[1]), int(key[2])
    i, j = int(key[4]), int(key[5])
    side = pdf["tile"].to_numpy()
    x = np.frombuffer(b"".join(pdf["vector"]), np.float64).reshape(-1, dim)
    bands = np.frombuffer(b"".join(pdf["bands"]), np.int32).reshape(len(pdf), -1)
    weight, node, factor = pdf["weight"].to_numpy(), pdf["node"].to_numpy(), pdf["factor"].to_numpy()
    code = np.frombuffer(b"".join(pdf["code"]), np.uint8).reshape(len(pdf), -1)
    left, right = np.flatnonzero(side == i), np.flatnonzero(side == j)
    count = np.zeros(len(pdf), np.int64)
    firsts, seconds = [], []
    if len(left) and len(right):
        if sigmas is None:
            floor = _certain_floor(factor, threshold)
        else:  # the least estimate of a pair at the threshold, within the bound
            floor = threshold - error_bound(factor, dim, sigmas) * math.sqrt(1 - threshold ** 2) - 1e-4
        for k in range(0, len(left), 512):
            part = left[k:k + 512]
            value = estimate(code[part], factor[part], x[right])
            u, v = np.nonzero(value >= floor[part][:, None].astype(np.float32))
            if 16 * len(u) > value.size:
                ok = (x[part] @ x[right].T)[u, v] >= threshold - 1e-12
                u, v = u[ok], v[ok]
            p, q = part[u], right[v]
            if i == j:
                p, q = p[p < q], q[p < q]
            if not len(p):
                continue
            ok = np.concatenate([np.einsum("ij,ij->i", x[p[c:c + 65536]], x[q[c:c + 65536]]) >= threshold
                                 for c in range(0, len(p), 65536)])
            p, q = p[ok], q[ok]
            if table:
                fresh = ~(bands[p, :table] == bands[q, :table]).any(axis=1)
                p, q = p[fresh], q[fresh]
            np.add.at(count, p, weight[q])
            np.add.at(count, q, weight[p])
            firsts.append(p)
            seconds.append(q)
    root = np.arange(len(pdf))
    if firsts:
        p, q = np.concatenate(firsts), np.concatenate(seconds)
        while True:
            low = root.copy()
            np.minimum.at(low, p, root[q])
            np.minimum.at(low, q, root[p])
            low = low[low]
            if (low == root).all():
                break
            root = low
    used = count > 0
    return pd.DataFrame({"node": node[used], "n": count[used], "root": node[root[used]]})


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, recall: float | None = None,
                    sigmas: float | None = None, tile: int = TILE) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Vectors of equal, non-null label and equal dimension link at a cosine
    (double precision) of at least ``threshold``; n_links counts the other
    vectors linked directly, component_id is the smallest vec_id reachable by
    links (its own included), kept is vec_id = component_id.  A vector that is
    null, empty, zero or holds a null or a non-finite component links with
    nothing.  A null vec_id takes part under no id: its row has n_links 0, a
    null component_id and kept false.  Repeated vec_ids are separate vectors with
    that id.  Other columns are ignored; an empty table gives an empty result.
    All links are found unless ``recall`` or ``sigmas`` is given (see above),
    which are for tables too large to compare every pair of a label.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"),
                          F.col("embedding").cast("array<double>").alias("embedding"),
                          F.col("label").cast("long").alias("label"))
    rows = stored(rows.mapInArrow(_vector_rows, "vec_id long, label long, dim int, node long, vector binary"), "vectors")
    nodes = stored(rows.where("node is not null and vec_id is not null").groupBy("node")
                   .agg(F.first("label").alias("label"), F.first("dim").alias("dim"), F.count(F.lit(1)).alias("weight"),
                        F.min("vec_id").alias("rep"), F.first("vector").alias("vector")), "nodes")
    bits, tables = 0, 1
    if recall is not None:
        largest = nodes.groupBy("label", "dim").count().agg(F.max("count")).first()[0] or 0
        bits, tables = plan_bands(largest, threshold, recall, tile)
    banded = nodes.select("label", "dim", "node", "weight", "vector").mapInArrow(
        lambda it: _banded_rows(it, bits, tables),
        "label long, dim int, t int, band int, node long, weight long, vector binary, code binary, factor double, bands binary")
    banded = stored(banded, "bands")
    where = ["label", "dim", "t", "band"]
    sizes = (banded.groupBy(*where).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
             .select(*where, F.ceil(F.col("n") / tile).cast("int").alias("tiles")))
    tiled = (banded.join(sizes, where).withColumn("tile", F.expr("cast(pmod(xxhash64(node), tiles) as int)"))
             .withColumn("other", F.explode(F.expr("sequence(0, tiles - 1)")))
             .withColumn("i", F.least("tile", "other")).withColumn("j", F.greatest("tile", "other")))
    links = stored(tiled.select(*where, "i", "j", "tile", "node", "weight", "vector", "code", "factor", "bands")
                   .groupBy(*where, "i", "j")
                   .applyInPandas(lambda k, pdf: _tile_links(k, pdf, threshold, sigmas), "node long, n long, root long"),
                   "links")
    counts = links.groupBy("node").agg(F.sum("n").alias("linked"))
    parts = connected_components(links.select(F.col("node").alias("a"), F.col("root").alias("b")))
    low = parts.join(nodes.select("node", "rep"), "node").groupBy("component").agg(F.min("rep").alias("low"))
    about = (nodes.select("node", "weight", "rep").join(counts, "node", "left").join(parts, "node", "left")
             .join(low, "component", "left")
             .select("node", (F.col("weight") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"),
                     F.coalesce("low", "rep").alias("low")))
    known = F.when(F.col("vec_id").isNotNull(), F.col("node"))
    return (rows.select("vec_id", known.alias("node")).join(about, "node", "left")
            .select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                    F.coalesce("low", "vec_id").alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False))))
