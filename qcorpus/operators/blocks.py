"""Blocks of vectors: the unit of work of vector search.

A block is one row that holds up to some thousand vectors as one packed matrix,
so a pair of blocks meets in a task by an ordinary equi-join and is compared by one
matrix product.  A task keeps the best k per query over all its pairs; what it
hands on is merged by one window, whose group limit runs before its shuffle.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StructField, StructType

BLOCK_ROWS = 4096
BUFFER_ROWS = 16 * BLOCK_ROWS  # rows that a packing task holds at most
TILE_QUERIES = 1024  # one similarity tile is at most 1024 x 4096 doubles, 32 MB
HELD_HITS = 1 << 19  # hits that a comparing task holds before it hands them on


def unit_rows(lists: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(row numbers, unit rows in double) of the vectors of ``dim`` finite
    components; a zero vector stays zero."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    sizes = lists.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(sizes == dim)
    values = lists.take(pa.array(rows)).flatten().cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
    x = values.reshape(-1, dim)
    good = np.isfinite(x).all(axis=1)
    x, rows = x[good], rows[good]
    norms = np.linalg.norm(x, axis=1, keepdims=True)
    return rows, np.divide(x, norms, out=np.zeros_like(x), where=norms > 0)


def packed(df: DataFrame, keys: Sequence[str], id_col: str, vec_col: str, dim: int, rows: int = BLOCK_ROWS,
           code: bool = False) -> DataFrame:
    """Blocks (keys, ids, data, scales) of the rows of ``df`` with equal keys that
    a task meets: unit vectors in double, or with ``code`` bytes and a scale per
    vector.  Rows with a null id, or a vector that is null, of another dimension
    or not finite, are left out."""
    df = df.select(*keys, F.col(id_col).alias("__id"), F.col(vec_col).alias("__vec")).where("__id is not null")
    schema = StructType([*(df.schema[k] for k in keys), StructField("ids", ArrayType(df.schema["__id"].dataType)),
                         StructField("n", IntegerType()), StructField("data", BinaryType()), StructField("scales", BinaryType())])
    arrow = to_arrow_schema(schema)
    id_type = to_arrow_schema(df.select("__id").schema).field(0).type

    def block(key, ids: list, parts: list[np.ndarray]) -> pa.RecordBatch:
        x, scales = np.concatenate(parts), None
        if code:
            scales = (np.abs(x).max(axis=1, keepdims=True) / 127).astype(np.float32)
            x = np.rint(np.divide(x, scales, out=np.zeros_like(x), where=scales > 0)).astype(np.int8)
        columns = [pa.array([v], arrow.field(k).type) for k, v in zip(keys, key)]
        columns += [pa.array([ids], pa.list_(id_type)), pa.array([len(ids)], pa.int32()), pa.array([x.tobytes()], pa.binary()),
                    pa.array([None if scales is None else scales.tobytes()], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, schema=arrow)

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: dict[tuple, tuple[list, list]] = {}
        held = 0
        for batch in batches:
            places, x = unit_rows(batch.column("__vec"), dim)
            if not len(places):
                continue
            batch = batch.take(pa.array(places))
            ids = batch.column("__id").to_pylist()
            groups: dict[tuple, list[int]] = {}
            for r, key in enumerate(zip(*(batch.column(k).to_pylist() for k in keys))):
                groups.setdefault(key, []).append(r)
            for key, at in groups.items():
                for lo in range(0, len(at), rows):
                    part = at[lo:lo + rows]
                    mine = open_.setdefault(key, ([], []))
                    if len(mine[0]) + len(part) > rows:
                        yield block(key, *open_.pop(key))
                        held -= len(mine[0])
                        mine = open_.setdefault(key, ([], []))
                    mine[0].extend(ids[r] for r in part)
                    mine[1].append(x[part])
                    held += len(part)
                while held > BUFFER_ROWS:
                    largest = max(open_, key=lambda k: len(open_[k][0]))
                    held -= len(open_[largest][0])
                    yield block(largest, *open_.pop(largest))
        for key in list(open_):
            yield block(key, *open_.pop(key))

    return df.mapInArrow(pack, schema)


def _matrix(row: dict, dim: int) -> np.ndarray:
    if row["scales"] is None:
        return np.frombuffer(row["data"], np.float64).reshape(-1, dim)
    codes = np.frombuffer(row["data"], np.int8).reshape(-1, dim).astype(np.float32)
    return codes * np.frombuffer(row["scales"], np.float32)[:, None]


def _best(q: np.ndarray, s: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the first k per query by similarity descending, then id."""
    order = np.lexsort((ids, -s, q))
    starts = np.flatnonzero(np.r_[True, q[order][1:] != q[order][:-1]]) if len(order) else np.zeros(0, np.int64)
    rank = np.arange(len(order)) - np.repeat(starts, np.diff(np.r_[starts, len(order)]))
    return order[rank < k]


def tile_hits(q: np.ndarray, x: np.ndarray, same: np.ndarray | None, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, vector row, similarity) of all pairs that reach their
    query's k-th best similarity, ties included.  Similarities are rounded to 12
    decimals, as a product's last bits depend on the tile and copies must tie."""
    sims = np.round(q @ x.T, 12)
    if same is not None:
        sims[same] = -np.inf
    at = max(sims.shape[1] - k, 0)
    kth = np.partition(sims, at, axis=1)[:, at:at + 1]
    row, col = np.nonzero((sims >= kth) & np.isfinite(sims))
    return row, col, sims[row, col]


def top_pairs(queries: DataFrame, vectors: DataFrame, keys: Sequence[str], dim: int, k: int, exclude_self: bool) -> DataFrame:
    """(query_id, id, similarity, rank): per query the best k vectors of the
    blocks that share its keys, ties by id."""
    q = queries.select(*keys, F.struct("ids", "n", "data", "scales").alias("q"))
    v = vectors.select(*keys, F.struct("ids", "n", "data", "scales").alias("v"))
    types = [d.schema["ids"].dataType.elementType for d in (queries, vectors)]
    schema = StructType([StructField("query_id", types[0]), StructField("id", types[1])]).add("similarity", "double")
    arrow = to_arrow_schema(schema)

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        count = 0

        def merged():
            qs, ids, s = (np.concatenate(c) for c in zip(*held))
            names, number = np.unique(qs, return_inverse=True)
            at = _best(number, s, ids, k)
            return qs[at], ids[at], s[at]

        def out(hits):
            return pa.RecordBatch.from_arrays([pa.array(c.tolist(), t.type) for c, t in zip(hits, arrow)], schema=arrow)

        for batch in batches:
            for r in range(batch.num_rows):
                a, b = batch.column("q")[r].as_py(), batch.column("v")[r].as_py()
                qm, vm = _matrix(a, dim), _matrix(b, dim)
                qi, vi = np.array(a["ids"]), np.array(b["ids"])
                for lo in range(0, len(qi), TILE_QUERIES):
                    names = qi[lo:lo + TILE_QUERIES]
                    for at in range(0, len(vi), BLOCK_ROWS):
                        same = names[:, None] == vi[None, at:at + BLOCK_ROWS] if exclude_self else None
                        row, col, s = tile_hits(qm[lo:lo + TILE_QUERIES], vm[at:at + BLOCK_ROWS], same, k)
                        held.append((names[row], vi[at:at + BLOCK_ROWS][col], s.astype(np.float64)))
                        count += len(s)
                if count > HELD_HITS:
                    held = [merged()]
                    count = len(held[0][2])
                    if count > HELD_HITS // 2:
                        yield out(held.pop())
                        count = 0
        if held:
            yield out(merged())

    hits = q.join(v, list(keys)).select("q", "v").mapInArrow(compare, schema)
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id")
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
