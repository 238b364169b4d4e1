"""Mixing sources to target weights by a low-discrepancy schedule.

Targets: sources in code point order (null last) get their weights in turn and
share ``budget`` times all words; a target stops at ``max_repeats`` times the
words of its source, the rest is shared by the others.

Schedule: slot i of the mix is the point frac(i * 0.618...) of the golden-ratio
sequence, looked up in the cumulative target shares, which gives its source.  A
slot stands for a block of ``block`` words.  The slots of a source are ranked;
slot rank r takes block r of the source's stream: its documents in a shuffled
order fixed by an MD5 of id and text, one after another, begun again from the
first when they are used up.  The last block of a source ends at its target.

The schedule is generated in chunks by Spark; ranks are local counts plus the
running total of earlier chunks.  Stream positions are running sums inside 4096
shuffle buckets per source plus the totals of earlier buckets.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import stored

WEIGHTS = (5, 2, 1)
BUDGET = Fraction(3, 2)
MAX_REPEATS = 2
BLOCK = 512
CHUNK = 1 << 16
MAX_SOURCES = 100_000
_GOLDEN = 0x9E3779B97F4A7C15  # 2**64 divided by the golden ratio, odd


def targets(sizes: Sequence[int], weights: Sequence[int] = WEIGHTS, budget: Fraction = BUDGET,
            max_repeats: int = MAX_REPEATS) -> list[float]:
    """Words to take per source (``sizes`` in source order)."""
    whole = float(budget * sum(sizes))
    weight = [weights[i % len(weights)] for i in range(len(sizes))]
    capped: set[int] = set()
    while True:
        free = [i for i in range(len(sizes)) if i not in capped]
        if not free:
            break
        unit = (whole - max_repeats * sum(sizes[i] for i in capped)) / sum(weight[i] for i in free)
        over = [i for i in free if unit * weight[i] > max_repeats * sizes[i]]
        if not over:
            break
        capped.update(over)
    return [float(max_repeats * s) if i in capped else unit * weight[i] for i, s in enumerate(sizes)]


def schedule(spark: SparkSession, goals: Sequence[int], block: int = BLOCK) -> DataFrame:
    """Slots of the mix (slot, source_no, rank): for source s exactly the ranks
    below ceil(goals[s] / block)."""
    need = [math.ceil(g / block) for g in goals]
    n = sum(need)
    shares = np.cumsum(np.array(need, dtype=object))
    cuts = np.array([int(c) * (1 << 64) // max(n, 1) for c in shares[:-1]], dtype=np.uint64)
    n_sources = len(need)

    def points(first: int) -> np.ndarray:
        i = np.arange(first, min(first + CHUNK, n), dtype=np.uint64)
        return np.searchsorted(cuts, i * np.uint64(_GOLDEN), side="right")

    def counted(batches):
        for batch in batches:
            for chunk in batch.column(0).to_pylist():
                c = np.bincount(points(chunk * CHUNK), minlength=n_sources)
                s = np.flatnonzero(c)
                yield pa.RecordBatch.from_pydict({"chunk": pa.array(np.full(len(s), chunk)),
                                                  "source_no": pa.array(s.astype(np.int32)), "n": pa.array(c[s])})

    def slots(batches):
        for batch in batches:
            for chunk, numbers, before in zip(*(batch.column(k).to_pylist() for k in range(3))):
                source = points(chunk * CHUNK)
                start = np.zeros(n_sources, np.int64)
                start[numbers] = before
                order = np.argsort(source, kind="stable")
                s = source[order]
                at = np.arange(len(s)) - np.searchsorted(s, s) + start[s]
                keep = at < np.array(need, np.int64)[s]
                yield pa.RecordBatch.from_pydict({
                    "slot": pa.array(chunk * CHUNK + order[keep]),
                    "source_no": pa.array(s[keep].astype(np.int32)), "rank": pa.array(at[keep])})

    chunks = spark.range(-(-n // CHUNK))
    counts = chunks.mapInArrow(counted, "chunk long, source_no int, n long")
    earlier = Window.partitionBy("source_no").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    told = (starts.groupBy("chunk").agg(F.collect_list(F.struct("source_no", "before")).alias("s"))
            .select("chunk", F.col("s.source_no").alias("numbers"), F.col("s.before").alias("before")))
    main = told.mapInArrow(slots, "slot long, source_no int, rank long")
    # what the sequence's discrepancy left short of a source's blocks comes last
    wanted = spark.createDataFrame([(i, k) for i, k in enumerate(need)], "source_no int, need long")
    short = (wanted.join(counts.groupBy("source_no").agg(F.sum("n").alias("have")), "source_no", "left")
             .withColumn("have", F.coalesce("have", F.lit(0))).where("have < need")
             .select(F.lit(n).cast("long").alias("slot"), "source_no", F.explode(F.expr("sequence(have, need - 1)")).alias("rank")))
    return main.union(short)


def mix_sources(docs: DataFrame, columns: Sequence[str] | None = None, weights: Sequence[int] = WEIGHTS,
                budget: Fraction = BUDGET, max_repeats: int = MAX_REPEATS, block: int = BLOCK) -> DataFrame:
    """The ``columns`` of ``docs`` (all by default) with size, source_size,
    target, taken, first_slot and parts; columns of ``docs`` with these names are
    left out.

    ``size`` counts words (runs of characters other than ASCII white space) of
    the text, 0 for null or blank ones; ``taken`` is the number of words that
    the mix takes of the document, repeats counted; ``parts`` lists per pass
    over the source (pass, first word, words, slot), passes counted from 0; slot is
    the slot of the mix whose block the part begins in (for copies, the first
    copy's), and ``first_slot`` the least of them, null where nothing is taken.
    Read in the order of the slots, any stretch of the mix holds the sources near
    their shares.

    Null is a source of its own, the last one.  Documents without words take
    part with 0.  Null or repeated doc_ids do not matter: rows equal in id, source
    and text are interchangeable and follow one another in the stream.  An
    empty table gives an empty result.  Raises if there are more than 100,000
    sources, as the targets are computed on the driver.
    """
    spark = docs.sparkSession
    added = ["size", "source_size", "target", "taken", "first_slot", "parts"]
    names = [c for c in (columns or docs.columns) if c not in added]
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    key = F.md5(F.concat(F.coalesce(docs["doc_id"].cast("string"), F.lit("")), F.lit(":"), text).cast("binary"))
    source = docs["source"].cast("string")
    # rows of equal key and source are one entry of the stream, ``copies`` times as long
    entries = stored(docs.select(source.alias("source"), key.alias("key"),
                                 F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("size"))
                     .groupBy("source", "key", "size").agg(F.count(F.lit(1)).alias("copies")), "entries")
    found = (entries.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("n"))
             .orderBy(F.asc_nulls_last("source")).limit(MAX_SOURCES + 1).collect())
    if len(found) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    goals = targets([r["n"] for r in found], weights, budget, max_repeats)
    info = spark.createDataFrame([(r["source"], i, r["n"], g, math.floor(g)) for i, (r, g) in enumerate(zip(found, goals))],
                                 "name string, source_no int, source_size long, target double, goal long")
    info = F.broadcast(info)  # at most MAX_SOURCES rows
    rows = (entries.join(info, F.col("source").eqNullSafe(F.col("name"))).drop("name", "source")
            .withColumn("length", F.col("size") * F.col("copies"))
            .withColumn("bucket", F.conv(F.substring("key", 1, 3), 16, 10).cast("int")))
    offsets = (rows.groupBy("source_no", "bucket").agg(F.sum("length").alias("n"))
               .withColumn("base", F.coalesce(F.sum("n").over(
                   Window.partitionBy("source_no").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
               .select("source_no", "bucket", "base"))
    inside = (Window.partitionBy("source_no", "bucket").orderBy("key")
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    stream = (rows.withColumn("upto", F.sum("length").over(inside)).join(offsets, ["source_no", "bucket"])
              .withColumn("start", F.col("base") + F.col("upto") - F.col("length"))
              .select("source_no", "key", "size", "length", "start", "source_size", "target", "goal"))
    stream = stored(stream, "stream")
    pieces = (stream.where("size > 0").select("source_no", "key", "start", "length", "source_size", "goal",
                                              F.explode(F.sequence(F.lit(0), F.lit(max_repeats - 1))).alias("pass"))
              .withColumn("lo", F.col("start") + F.col("pass") * F.col("source_size")).where("lo < goal")
              .withColumn("hi", F.least(F.col("lo") + F.col("length"), "goal"))
              .withColumn("rank", F.explode(F.expr(f"sequence(lo div {block}, (hi - 1) div {block})"))))
    slots = schedule(spark, [math.floor(g) for g in goals], block).select("source_no", "rank", "slot")
    took = (pieces.join(slots, ["source_no", "rank"])
            .withColumn("n", F.least("hi", (F.col("rank") + 1) * block) - F.greatest("lo", F.col("rank") * block))
            # slots of a source leave no gap, and rise with their rank
            .groupBy("source_no", "key", "pass").agg(F.sum("n").alias("n"), F.min("slot").alias("slot"))
            .groupBy("source_no", "key").agg(F.array_sort(F.collect_list(F.struct("pass", "n", "slot"))).alias("passes")))
    about = stream.select("source_no", "key", "size", "source_size", "target").join(took, ["source_no", "key"], "left")
    about = about.join(info.select("source_no", "name"), "source_no")
    full = docs.select(F.struct(*[docs[c].alias(f"in_{c}") for c in names]).alias("row"), source.alias("source"),
                       key.alias("key"))
    joined = (full.join(about.withColumnRenamed("key", "key2"),
                        (F.col("key") == F.col("key2")) & F.col("source").eqNullSafe(F.col("name")))
              .withColumn("copy", F.row_number().over(Window.partitionBy("key", "source").orderBy("size")) - 1))
    begin = F.col("copy") * F.col("size")
    parts = F.filter(F.transform("passes", lambda p: F.struct(
        p["pass"].alias("pass"), F.lit(0).cast("long").alias("first"),
        F.least("size", F.greatest(F.lit(0), p["n"] - begin)).cast("long").alias("words"),
        p["slot"].alias("slot"))), lambda p: p["words"] > 0)
    out = joined.withColumn("parts", F.coalesce(parts, F.array().cast("array<struct<pass:int,first:bigint,words:bigint,slot:bigint>>")))
    return out.select(*[F.col("row")[f"in_{c}"].alias(c) for c in names], "size", "source_size", "target",
                      F.aggregate("parts", F.lit(0).cast("long"), lambda n, p: n + p["words"]).alias("taken"),
                      F.array_min(F.transform("parts", lambda p: p["slot"])).alias("first_slot"), "parts")
