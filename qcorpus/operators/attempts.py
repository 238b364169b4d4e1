"""Retry resolution over an attempts table.

An attempts table has one row per (item, attempt) with the target class and
the class the scorer gave the attempt's SQL (``parse_error`` when the model
output did not parse, null when no bucket was active).  Items are small
groups (at most ``max_attempts`` rows), so grouping by item is a cheap,
well-spread shuffle; no window runs over a large group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_ATTEMPTS = 4  # fixed value: attempts per item


def attempt_outcome(cls: Column, target: Column) -> Column:
    """Reason of one attempt: parse_error, no_bucket_active, accepted,
    forbidden_kw (aggregation target classified complex) or wrong_class."""
    return (F.when(cls == "parse_error", "parse_error")
            .when(cls.isNull(), "no_bucket_active")
            .when(cls == target, "accepted")
            .when((target == "aggregation") & (cls == "complex"), "forbidden_kw")
            .otherwise("wrong_class"))


def first_accepted(attempts: DataFrame, item="item_id", attempt="attempt",
                   cls="cls", target="target") -> DataFrame:
    """Per item: target and the first attempt whose class equals the target."""
    ok = F.col(cls) == F.col(target)
    return attempts.groupBy(item).agg(
        F.max(target).alias("target"),
        F.min(F.when(ok, F.col(attempt))).alias("accepted_attempt"),
    )


def attempt_outcomes(attempts: DataFrame, item="item_id", attempt="attempt",
                     cls="cls", target="target") -> DataFrame:
    """E6 on the attempts actually made: those up to and including the first
    accepted one (the reference stops retrying on acceptance).  The first
    accepted attempt is a window minimum over the item (at most
    ``MAX_ATTEMPTS`` rows): one shuffle, no aggregate-and-join-back."""
    first_ok = F.min(F.when(F.col(cls) == F.col(target), F.col(attempt))).over(Window.partitionBy(item))
    made = attempts.withColumn("accepted_attempt", first_ok).filter(
        F.col("accepted_attempt").isNull() | (F.col(attempt) <= F.col("accepted_attempt")))
    return made.withColumn("outcome", attempt_outcome(F.col(cls), F.col(target))) \
               .withColumn("refined", F.col(attempt) > 1).drop("accepted_attempt")


def resolve_attempts(attempts: DataFrame, item="item_id", attempt="attempt",
                     cls="cls", target="target", max_attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """E5: per item, accepted at the first matching attempt (with
    was_refined = attempt > 1) or ``max_retry_exhausted``."""
    r = first_accepted(attempts.filter(F.col(attempt) <= max_attempts), item, attempt, cls, target)
    acc = F.col("accepted_attempt")
    return r.select(
        item, "target",
        F.when(acc.isNotNull(), "accepted").otherwise("max_retry_exhausted").alias("resolution"),
        acc.cast("bigint").alias("accepted_attempt"),
        F.when(acc.isNotNull(), acc > 1).alias("was_refined"),
    )


def attempt_stats(outcomes: DataFrame) -> DataFrame:
    """D3: attempt counters over :func:`attempt_outcomes`.  ``timeout`` is kept
    as a column; the reference declares it but never increments it."""
    o = F.col("outcome")
    return outcomes.agg(
        F.count(F.lit(1)).alias("attempts"),
        F.count_if(o == "accepted").alias("accepted"),
        F.count_if(F.col("refined")).alias("refined"),
        F.count_if(o == "parse_error").alias("parse_err"),
        F.count_if(o == "no_bucket_active").alias("no_bucket_active"),
        F.count_if(o == "wrong_class").alias("wrong_class"),
        F.count_if(o == "forbidden_kw").alias("forbidden_kw"),
        F.lit(0).cast("bigint").alias("timeout"),
    )


def generate_until_class(items: DataFrame, generate, score, max_rounds: int = MAX_ATTEMPTS,
                         item="item_id", target="target", sql_col="sql") -> DataFrame:
    """I4: retry loop in batch.  Each round runs ``generate(pending, round)``
    (a DataFrame -> DataFrame step returning ``item, target, sql``, e.g. a
    ``batch_generate`` call) only on unresolved items, scores with
    ``score(df) -> df`` (adds ``difficulty`` and ``buckets_present``), and
    keeps the accepted rows (``outcome`` = ``accepted``).  Items without an
    accepted row after the last round come back with their last row, or with
    their own columns where the generator gave none, and the outcome
    ``max_retry_exhausted``.  From round 2 on, ``pending`` carries the
    feedback of the item's previous attempt: ``last_sql``,
    ``missing_buckets`` (B9) and ``forbidden_found`` (B10), for the
    refinement prompt.

    Rounds are cut from their lineage with a reliable checkpoint into the
    cluster's checkpoint folder, so a lost executor does not replay the
    model calls of earlier rounds.
    """
    from qcorpus.functions.scoring import forbidden_words, missing_buckets
    from qcorpus.session import cut_lineage

    rounds = []
    pending = items
    for rnd in range(1, max_rounds + 1):
        if pending.limit(1).count() == 0:  # every item resolved: no more model calls
            break
        out = score(generate(pending, rnd)).withColumn("attempt", F.lit(rnd))
        out = cut_lineage(out)
        ok = out.filter(F.col("difficulty") == F.col(target))
        rounds.append((out, ok))
        present = F.coalesce(F.col("buckets_present"), F.array().cast("array<string>"))
        feedback = out.join(ok.select(item), item, "left_anti").select(
            item, F.col(sql_col).alias("last_sql"),
            missing_buckets(present, F.col(target)).alias("missing_buckets"),
            forbidden_words(F.col(sql_col), F.col(target)).alias("forbidden_found")).dropDuplicates([item])
        # the next round's input is cut from this round's lineage too; items
        # that the generator returned no row for stay pending without feedback
        todo = pending.select(item).join(ok.select(item), item, "left_anti")
        pending = cut_lineage(items.join(todo, item, "left_semi").join(feedback, item, "left"))
    if not rounds:  # no items: the empty result has the columns of a round
        return score(generate(items, 1)).withColumn("attempt", F.lit(1)).withColumn("outcome", F.lit("accepted")).limit(0)
    result = None
    for _, ok in rounds:
        part = ok.withColumn("outcome", F.lit("accepted"))
        result = part if result is None else result.unionByName(part, allowMissingColumns=True)
    last = rounds[-1][0].join(pending.select(item), item, "left_semi").dropDuplicates([item])
    lost = pending.join(last.select(item), item, "left_anti").select(*[c for c in items.columns])
    failed = last.unionByName(lost, allowMissingColumns=True).withColumn("outcome", F.lit("max_retry_exhausted"))
    return result.unionByName(failed, allowMissingColumns=True)
