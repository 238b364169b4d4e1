"""Exact row numbering that scales to huge groups.

``row_number() over (partition by g order by k)`` sends each group ``g`` to a
single task; with a handful of classes and one class holding a third of all
rows that task is the whole job.  :func:`bucketed_row_number` gives the same
numbers but never puts more than ``bucket_width`` rows in one window group:

1. split the order key into ranges ``bucket = floor((k - origin) / width)``,
   the width sized from the key's min/max/count unless given;
2. number rows inside ``(g, bucket)`` (bounded window groups);
3. count rows per ``(g, bucket)`` -- a small table, one row per bucket --
   and turn it into offsets with a running sum over the buckets of ``g``;
4. join the offsets back (broadcast-sized: #groups x #buckets rows) and add.

The result is a pure function of the data (no dependence on physical
partitioning), so recomputation after an executor loss yields equal numbers.
The order key must be integral and unique within a group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TARGET_ROWS_PER_BUCKET = 1 << 20


def _key_stats(df: DataFrame, order_col: str) -> tuple[int, int, int]:
    r = df.agg(F.min(order_col).alias("lo"), F.max(order_col).alias("hi"), F.count(F.lit(1)).alias("n")).first()
    if r["n"] == 0 or r["lo"] is None:
        return 0, 0, 0
    return int(r["lo"]), int(r["hi"]), int(r["n"])


def _width_from_stats(lo: int, hi: int, n: int, target_rows: int) -> tuple[int, int]:
    if n == 0:
        return 0, 1
    buckets = max(1, -(-n // target_rows))
    return lo, max(1, -(-(hi - lo + 1) // buckets))


def _adaptive_width(df: DataFrame, order_col: str, target_rows: int) -> tuple[int, int]:
    """(origin, width) of key ranges holding about ``target_rows`` rows each
    on average, from one aggregate (min, max, count) of the key: sparse keys
    (e.g. hashed ids) get wide ranges, so the offsets table stays small."""
    return _width_from_stats(*_key_stats(df, order_col), target_rows)


def _quantile_buckets(df: DataFrame, order_col: str, target_rows: int, out: str) -> DataFrame:
    """Bucket = rank of the key among approximate quantiles of the key (one
    ``percentile_approx`` pass; the boundaries, one per ``target_rows`` rows,
    are metadata-sized), assigned by binary search (``Bucketizer``).  The
    assignment is monotone in the key, which is all exact numbering needs."""
    from pyspark.ml.feature import Bucketizer
    n = df.select(F.count(F.lit(1))).first()[0]
    nb = max(1, -(-n // target_rows))
    kd = F.col(order_col).cast("double")
    if nb == 1:
        return df.withColumn(out, F.lit(0).cast("bigint"))
    probs = [i / nb for i in range(1, nb)]
    qs = df.select(F.percentile_approx(kd, probs, max(10_000, 4 * nb)).alias("q")).first()["q"] or []
    splits = [float("-inf")] + sorted(set(float(x) for x in qs)) + [float("inf")]
    keyed = df.withColumn("__kd", kd)
    return Bucketizer(splits=splits, inputCol="__kd", outputCol="__bd").transform(keyed) \
        .withColumn(out, F.col("__bd").cast("bigint")).drop("__kd", "__bd")


def bucketed_row_number(df: DataFrame, partition_cols: list[str], order_col: str,
                        out_col: str = "row_number", bucket_width: int | None = None,
                        target_rows: int = TARGET_ROWS_PER_BUCKET, method: str = "auto") -> DataFrame:
    """``df`` plus ``out_col`` = 1-based position of the row inside its
    partition group in ascending ``order_col``.  Key ranges: ``bucket_width``
    when given; else ``method="width"`` sizes equal-width ranges from the
    key's min/max/count, ``method="quantiles"`` uses approximate quantiles
    (balanced ranges for any key distribution, one more pass), and
    ``method="auto"`` picks equal widths for dense keys (span at most four
    times the row count) and quantiles otherwise; about ``target_rows`` rows
    per range."""
    b = "__bucket"
    stats = None
    if bucket_width is None and method == "auto":
        stats = _key_stats(df, order_col)
        lo, hi, n = stats
        method = "width" if n == 0 or (hi - lo + 1) <= 4 * n else "quantiles"
    if bucket_width is None and method == "quantiles":
        keyed = _quantile_buckets(df, order_col, target_rows, b)
    else:
        origin = 0
        if bucket_width is None:
            origin, bucket_width = (_width_from_stats(*stats, target_rows) if stats
                                    else _adaptive_width(df, order_col, target_rows))
        keyed = df.withColumn(b, F.floor((F.col(order_col) - F.lit(origin)) / F.lit(bucket_width)).cast("bigint"))
    # rows without an order key come first, in a range of their own
    keyed = keyed.withColumn(b, F.coalesce(F.col(b), F.lit(-(1 << 62))))
    local = Window.partitionBy(*partition_cols, b).orderBy(order_col)
    counts = keyed.groupBy(*partition_cols, b).agg(F.count(F.lit(1)).alias("__n"))
    keyed = keyed.withColumn("__local_rn", F.row_number().over(local))
    running = Window.partitionBy(*partition_cols).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("__offset", F.coalesce(F.sum("__n").over(running), F.lit(0))).drop("__n")
    out = keyed.join(offsets, on=[*partition_cols, b], how="inner")
    return out.withColumn(out_col, (F.col("__offset") + F.col("__local_rn")).cast("bigint")) \
              .drop(b, "__local_rn", "__offset")


def first_rows(df: DataFrame, group_col: str, order_col: str, limits: DataFrame, out_col: str = "row_number",
               buckets: int = 512) -> DataFrame:
    """The first ``limit`` rows of each group in ``order_col`` order (``limits``:
    group, limit; a few rows) and their position.

    Keys are dealt into ranges and the ranges of each group counted, which is
    combined in the tasks.  Ranges that begin past the limit are dropped before
    anything is shuffled or sorted; the others are numbered range by range.  So
    the rows that move are those that stay, and at most one range a group more."""
    b = "__bucket"
    lo, hi, n = _key_stats(df, order_col)
    if n == 0 or (hi - lo + 1) <= 4 * n:
        width = max(1, -(-(hi - lo + 1) // max(buckets, -(-n // TARGET_ROWS_PER_BUCKET))))
        keyed = df.withColumn(b, F.floor((F.col(order_col) - F.lit(lo)) / F.lit(width)).cast("bigint"))
    else:
        keyed = _quantile_buckets(df, order_col, max(1, min(TARGET_ROWS_PER_BUCKET, -(-n // buckets))), b)
    keyed = keyed.withColumn(b, F.coalesce(F.col(b), F.lit(-(1 << 62))))  # rows without a key come first
    counts = keyed.groupBy(group_col, b).agg(F.count(F.lit(1)).alias("__n"))
    running = Window.partitionBy(group_col).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("__before", F.coalesce(F.sum("__n").over(running), F.lit(0))).drop("__n")
    reached = offsets.join(F.broadcast(limits.toDF(group_col, "__limit")), group_col).where("__before < __limit")
    # ``buckets`` rows a group at most while a range holds under TARGET_ROWS_PER_BUCKET rows
    kept = keyed.join(F.broadcast(reached) if n < TARGET_ROWS_PER_BUCKET * buckets else reached, [group_col, b])
    local = Window.partitionBy(group_col, b).orderBy(order_col)
    return (kept.withColumn(out_col, (F.col("__before") + F.row_number().over(local)).cast("bigint"))
            .where(F.col(out_col) <= F.col("__limit")).drop(b, "__before", "__limit"))


def global_row_number(df: DataFrame, order_col: str, out_col: str = "row_number",
                      bucket_width: int | None = None) -> DataFrame:
    """Sequential 1-based id over the whole DataFrame in ``order_col`` order,
    without a single-partition window."""
    return bucketed_row_number(df.withColumn("__all", F.lit(0)), ["__all"], order_col,
                               out_col, bucket_width).drop("__all")


def batch_id(row_number: Column, batch_size: int = 512) -> Column:
    """Fixed-size batch number from a 1-based row number."""
    return F.floor((row_number - F.lit(1)) / F.lit(batch_size)).cast("bigint")
