"""Corpus-level operators: distributions, quotas, balancing, curation
funnels (D1, D2, D4-D7, D18, E1, E2, E7, B24).

All aggregations are single ``groupBy``/``agg`` passes (partial aggregation
before the shuffle); windows only run over tiny aggregated tables, never over
the corpus itself, except through the bucketed numbering of ``ranking``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from qcorpus.functions.scoring import CLASSES
from qcorpus.functions.status import accuracy_band, strip_ws
from qcorpus.operators.ranking import first_rows, global_row_number

# Share of the corpus per class (the last class takes the rest).
QUOTA_PCT = {"simple": 0.25, "conditional": 0.25, "aggregation": 0.25, "complex": 0.25}


def _classes_df(spark, classes=None) -> DataFrame:
    classes = classes or CLASSES
    return spark.createDataFrame([(c, i) for i, c in enumerate(classes)], "class string, class_pos int")


def distribution(df: DataFrame, class_col: str = "difficulty", total: int | None = None,
                 value_col: str | None = None, classes=None) -> DataFrame:
    """Count per class (every configured class, zero included), percent of
    ``total`` (default: all rows), a text bar of ``floor(pct/2)`` blocks and,
    optionally, the mean of ``value_col``.

    One pass over ``df``: the grouped counts (a handful of rows) also give
    the total, by a window over that small table, so the input is not
    scanned a second time."""
    aggs = [F.count(F.lit(1)).alias("count")]
    if value_col:
        aggs.append(F.avg(value_col).alias("mean_value"))
    # null classes are grouped under "" (matching no configured class): a
    # nullable key would let the optimizer push an inferred ``isnotnull``
    # filter below the scoring projection and evaluate it twice
    counts = df.groupBy(F.coalesce(F.col(class_col), F.lit("")).alias("class")).agg(*aggs)
    if total is None:
        counts = counts.withColumn("__total", F.sum("count").over(Window.partitionBy()))
        tot = F.max("__total").over(Window.partitionBy())
    else:
        tot = F.lit(total)
    # only the configured classes are kept before the broadcast: its size is
    # bounded by the class list, whatever the column holds
    counts = counts.filter(F.col("class").isin(list(classes or CLASSES)))
    out = _classes_df(df.sparkSession, classes).join(F.broadcast(counts), "class", "left")
    if total is None:
        # classes with no rows get the total from the other rows of this tiny table
        out = out.withColumn("__total", tot)
        tot = F.coalesce(F.col("__total"), F.lit(0))
    cnt = F.coalesce(F.col("count"), F.lit(0)).cast("bigint")
    pct = F.when(tot > 0, cnt.cast("double") / tot.cast("double") * 100.0).otherwise(F.lit(0.0))
    cols = [F.col("class"), F.col("class_pos").cast("bigint").alias("class_pos"), cnt.alias("count"),
            F.round(pct, 2).alias("pct"), F.repeat(F.lit("█"), F.floor(pct / 2).cast("int")).alias("bar")]
    if value_col:
        cols.append(F.round(F.coalesce(F.col("mean_value"), F.lit(0.0)), 4).alias("mean_value"))
    return out.select(*cols)


def status_distribution(df: DataFrame, status_col: str = "status") -> DataFrame:
    """Rows per status (missing -> 'missing'), percent of all rows,
    by count descending then name."""
    counts = df.groupBy(F.coalesce(F.col(status_col), F.lit("missing")).alias("status")) \
               .agg(F.count(F.lit(1)).alias("count"))
    w = Window.partitionBy()  # over the few status rows only
    total = F.sum("count").over(w)
    return counts.select("status", F.col("count").cast("bigint").alias("count"),
                         F.round(F.col("count") / total * 100.0, 2).alias("pct")) \
                 .orderBy(F.desc("count"), "status")


def quota_targets(spark, total: int | DataFrame, quota_pct: dict | None = None) -> DataFrame:
    """``floor(total * pct)`` per class in configured order; the last class
    receives the remainder.  ``total`` may be an int or a one-cell DataFrame
    (e.g. a count computed by Spark)."""
    quota_pct = quota_pct or QUOTA_PCT
    classes = list(quota_pct)
    cfg = spark.createDataFrame([(c, i, float(quota_pct[c])) for i, c in enumerate(classes)],
                                "class string, class_pos int, quota_pct double")
    if isinstance(total, DataFrame):
        tot = total.select(F.col(total.columns[0]).cast("bigint")).scalar()
    else:
        tot = F.lit(int(total)).cast("bigint")
    cfg = cfg.withColumn("total", tot)
    base = F.floor(F.col("total") * F.col("quota_pct")).cast("bigint")
    w = Window.partitionBy().orderBy("class_pos").rowsBetween(Window.unboundedPreceding, -1)
    is_last = F.col("class_pos") == len(classes) - 1
    cfg = cfg.withColumn("base", base).withColumn("before", F.coalesce(F.sum("base").over(w), F.lit(0)))
    quota = F.when(is_last, F.col("total") - F.col("before")).otherwise(F.col("base"))
    return cfg.select("class", F.col("class_pos").cast("bigint").alias("class_pos"), quota.alias("quota"))


def quota_sample(df: DataFrame, quotas: DataFrame, class_col: str = "difficulty",
                 order_col: str = "question_id") -> DataFrame:
    """At most ``quota`` rows per class, the first ones in ``order_col``, with
    their class_rank.  Rows past the quota are dropped by key range before they are
    sorted or shuffled, and a class of any size is spread over many tasks."""
    # unclassified rows are numbered under "" and dropped by the inner join;
    # a null filter here would be pushed below (and re-run) the projection
    # that computes the class
    keyed = df.withColumn(class_col, F.coalesce(F.col(class_col), F.lit("")))
    return first_rows(keyed, class_col, order_col, quotas.select("class", "quota"), "class_rank")


def neediest_class(collected: DataFrame, quotas: DataFrame) -> DataFrame:
    """The class below its quota with the lowest collected/quota ratio; ties
    go to the earlier configured class.  ``collected`` has (class, count)."""
    j = quotas.join(collected, "class", "left") \
              .withColumn("collected", F.coalesce(F.col("count"), F.lit(0)).cast("bigint"))
    j = j.filter(F.col("collected") < F.col("quota"))
    ratio = F.col("collected").cast("double") / F.col("quota").cast("double")
    first = j.select("class", "class_pos", "collected", "quota", ratio.alias("ratio")).orderBy("ratio", "class_pos").limit(1)
    return first.withColumn("ratio", F.round("ratio", 6))


def assign_ids(df: DataFrame, order_col: str, out_col: str = "seq_id") -> DataFrame:
    """Sequential ids in ``order_col`` order (no single-partition window)."""
    return global_row_number(df, order_col, out_col)


def select_indexable(df: DataFrame, wanted_status: str = "valid_quality", id_col: str = "question_id",
                     idx_col: str | None = None) -> DataFrame:
    """Rows of the wanted status with non-blank question and SQL, with the
    index fields (id default ``auto_<idx>``, idx being ``idx_col`` or a hash of
    question and SQL; db_id default ``unknown``)."""
    q, s = strip_ws(F.col("question")), strip_ws(F.col("sql"))
    kept = df.filter((F.col("status") == wanted_status) & (F.coalesce(q, F.lit("")) != "")
                     & (F.coalesce(s, F.lit("")) != ""))
    idx = F.col(idx_col) if idx_col else F.hex(F.xxhash64(q, s))  # the same on every run
    source_id = F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("auto_"), idx.cast("string")))
    return kept.select(
        source_id.alias("id"),
        q.alias("document"),
        F.struct(q.alias("question"), s.alias("sql"),
                 F.coalesce(F.col("db_id"), F.lit("unknown")).alias("db_id"),
                 source_id.alias("source_id"), F.col("status")).alias("metadata"),
    )


def _funnel_aggs(wanted_status: str, extra_db_count: bool = False):
    st = F.col("status")
    blank = (F.coalesce(strip_ws(F.col("question")), F.lit("")) == "") | \
            (F.coalesce(strip_ws(F.col("sql")), F.lit("")) == "")
    aggs = [
        F.count(F.lit(1)).alias("total_entries"),
        F.count_if(st.isNull()).alias("missing_quality_field"),
        F.count_if(st.isNotNull() & (st != wanted_status)).alias("failed_quality_check"),
        F.count_if((st == wanted_status) & blank).alias("missing_question_sql"),
        F.count_if((st == wanted_status) & ~blank).alias("passed_quality_check"),
    ]
    if extra_db_count:
        # G3 in the same pass: distinct databases among the kept rows
        kept = (st == wanted_status) & ~blank
        aggs.append(F.count_distinct(F.when(kept, F.coalesce(F.col("db_id"), F.lit("unknown"))))
                    .alias("unique_databases_indexed"))
    return aggs


def filter_funnel(df: DataFrame, wanted_status: str = "valid_quality") -> DataFrame:
    """One row of mutually exclusive counts: missing status, failed status,
    missing question/sql, indexed (= passed); one aggregation pass."""
    return df.agg(*_funnel_aggs(wanted_status)).withColumn("final_indexed", F.col("passed_quality_check"))


def build_summary(df: DataFrame, vectors: DataFrame | None = None,
                  wanted_status: str = "valid_quality") -> DataFrame:
    """Funnel plus distinct databases among kept rows (G3), in the same
    pass over the corpus; vectors per entry and the embedding dimension and
    count (scalar subqueries over the vector table, when given)."""
    out = df.agg(*_funnel_aggs(wanted_status, extra_db_count=True)) \
            .withColumn("final_indexed", F.col("passed_quality_check")) \
            .withColumn("vectors_per_entry", F.lit(1).cast("bigint"))
    out = out.select("total_entries", "missing_quality_field", "failed_quality_check", "missing_question_sql",
                     "passed_quality_check", "final_indexed", "unique_databases_indexed", "vectors_per_entry")
    if vectors is not None:
        out = out.withColumn("embedding_dimension",
                             vectors.select(F.max(F.size("embedding")).cast("bigint")).scalar()) \
                 .withColumn("total_indexed_vectors", vectors.select(F.count(F.lit(1))).scalar())
    return out


def validation_stats(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(counters total/valid/invalid/timeout, error histogram by type)
    over a table with ``status`` and ``validation_error``."""
    err = F.col("validation_error")
    counters = df.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("status") == "validated").alias("valid"),
        F.count_if(F.col("status") != "validated").alias("invalid"),
        F.count_if(err == "TIMEOUT").alias("timeout"),
    )
    hist = df.filter(err.isNotNull()).groupBy(err.alias("validation_error")) \
             .agg(F.count(F.lit(1)).alias("count"))
    return counters, hist


def quality_stats(df: DataFrame, status_col: str = "status") -> DataFrame:
    """D5 + B27: judge counters, accuracy = correct / total x 100 and its band."""
    st = F.col(status_col)
    out = df.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(st == "valid_quality").alias("correct"),
        F.count_if(st == "invalid_quality").alias("incorrect"),
        F.count_if(st == "judge_failed").alias("judge_failed"),
        F.count_if(st == "execution_failed").alias("execution_failed"),
    )
    acc = F.when(F.col("total") > 0, F.col("correct") / F.col("total") * 100.0).otherwise(F.lit(0.0))
    return out.withColumn("accuracy", F.round(acc, 2)).withColumn("band", accuracy_band(F.col("accuracy")))


def first_records(df: DataFrame, n: int, order_col: str) -> DataFrame:
    """the first ``n`` records by ``order_col`` for a smoke run
    (TakeOrdered: each task keeps ``n`` rows)."""
    return df.orderBy(order_col).limit(n)
