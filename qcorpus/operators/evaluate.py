"""Evaluation operators."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qcorpus.functions.text import exact_match, extract_fenced

_TOKEN_SPLIT = re.compile(r"[^a-z0-9]+")


def rouge_tokens(text: str, stem: bool = True) -> list[str]:
    """Tokens as the ROUGE scorer makes them: lower case, non-alphanumerics
    as separators, and (``stem``, the reference's setting) Porter stems for
    tokens longer than 3 characters."""
    from qcorpus.functions.stemming import porter_stem
    toks = [t for t in _TOKEN_SPLIT.split((text or "").lower()) if t]
    return [porter_stem(t) if stem and len(t) > 3 else t for t in toks] if stem else toks


def lcs_length(a: list, b: list) -> int:
    """Length of the longest common subsequence, bit-parallel: one integer holds
    a bit per token of ``a`` and is updated once per token of ``b``."""
    places: dict = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | (1 << i)
    mask = (1 << len(a)) - 1
    row = mask
    for y in b:
        hit = row & places.get(y, 0)
        row = ((row + hit) | (row - hit)) & mask
    return len(a) - row.bit_count()


def rouge_l(pred: Column | str, gold: Column | str, stem: bool = True) -> Column:
    """STRUCT(p, r, f1) of ROUGE-L between prediction and reference:
    P = lcs/len(pred), R = lcs/len(gold), F1 = 2PR/(P+R), on stemmed tokens
    by default (the reference scores with stemming on).  Arrow-batched
    pandas UDF (the LCS dynamic programme is a small per-row helper over
    whole texts; no length cap)."""
    @F.pandas_udf("struct<p:double,r:double,f1:double>")
    def score(p: pd.Series, g: pd.Series) -> pd.DataFrame:
        ps, rs, fs = [], [], []
        for a, b in zip(p.tolist(), g.tolist()):
            ta, tb = rouge_tokens(a, stem), rouge_tokens(b, stem)
            lcs = lcs_length(ta, tb)
            pp = lcs / len(ta) if ta else 0.0
            rr = lcs / len(tb) if tb else 0.0
            ps.append(pp)
            rs.append(rr)
            fs.append(2 * pp * rr / (pp + rr) if pp + rr > 0 else 0.0)
        return pd.DataFrame({"p": ps, "r": rs, "f1": fs})

    c = (lambda x: F.col(x) if isinstance(x, str) else x)
    return score(F.coalesce(c(pred), F.lit("")), F.coalesce(c(gold), F.lit("")))


TILE = 1024  # tokens of a side that meet in one product


def _tile_scores(batches):
    """Best cosine of every token within its tile.  A pair of one tile gives a
    row per side with the sum and the number of tokens (``at`` -1); tiles of
    larger pairs give a row per token."""
    def matrix(cell):
        tokens = cell.values
        if tokens is None or len(tokens) == 0:
            return np.zeros((0, 0))
        return tokens.field("u").flatten().to_numpy(zero_copy_only=False).reshape(len(tokens), -1)

    for batch in batches:
        source, side, block, at, best, n = [], [], [], [], [], []
        for k in range(batch.num_rows):
            sides = matrix(batch.column("p")[k]), matrix(batch.column("g")[k])
            both = len(sides[0]) and len(sides[1])
            cosines = sides[0] @ sides[1].T if both else None
            whole = batch.column("tiles")[k].as_py() == 1
            for s, (tokens, own) in enumerate(zip(sides, ("i", "j"))):
                found = cosines.max(axis=1 - s) if both else np.full(len(tokens), 0.0 if whole else -np.inf)
                if whole:
                    found, places, count = [float(found.sum())], [-1], len(tokens)
                else:
                    places, count = range(len(tokens)), 1
                source += [k] * len(found)
                side += [s] * len(found)
                block += [batch.column(own)[k].as_py()] * len(found)
                at += places
                best += list(found)
                n += [count] * len(found)
        yield pa.RecordBatch.from_arrays(
            [batch.column("pair").take(pa.array(source, pa.int64())), pa.array(side, pa.int32()), pa.array(block, pa.int32()),
             pa.array(at, pa.int32()), pa.array(best, pa.float64()), pa.array(n, pa.int64())],
            names=["pair", "side", "block", "at", "best", "n"])


def greedy_match_score(tokens: DataFrame, pair_col: str = "pair_id", side_col: str = "side",
                       pos_col: str = "pos", vec_col: str = "embedding", tile: int = TILE) -> DataFrame:
    """Greedy matching of token embeddings within each pair (the score
    BERTScore computes on top of its encoder): P = mean over prediction
    tokens of the best cosine to a reference token, R likewise from the
    reference side, F1 = 2PR/(P+R).  ``side`` 0 = prediction, 1 = reference.

    A pair's token matrices are multiplied in Arrow batches.  A side of more
    than ``tile`` tokens is dealt into blocks by a hash of the token, and every
    block of one side meets every block of the other in a row of its own, so no
    task holds more than two blocks of a pair; the best of a token over its
    tiles is a maximum that merges before the shuffle.  Tokens with a null
    vector are left out; the vectors of a pair have one length.  A pair with one
    side empty scores 0."""
    from qcorpus.operators.vectors import l2_normalize
    t = tokens.select(F.col(pair_col).alias("pair"), F.col(side_col).cast("int").alias("side"),
                      F.col(pos_col).alias("pos"), l2_normalize(vec_col).alias("u"))
    blocks = [F.greatest(F.ceil(F.count_if(F.col("side") == s) / tile), F.lit(1)).cast("int").alias(b)
              for s, b in enumerate(("b0", "b1"))]
    large = t.groupBy(F.col("pair").alias("large")).agg(*blocks).where("b0 > 1 or b1 > 1")  # at most a row per tile
    t = t.join(large, F.col("pair").eqNullSafe(F.col("large")), "left").fillna(1, ["b0", "b1"])
    first = F.col("side") == 0
    own = F.pmod(F.xxhash64("pos", "u"), F.when(first, F.col("b0")).otherwise(F.col("b1"))).cast("int")
    met = F.sequence(F.lit(0), F.when(first, F.col("b1")).otherwise(F.col("b0")) - 1)
    t = t.withColumn("own", own).withColumn("met", F.explode(met))
    t = t.withColumn("i", F.when(first, F.col("own")).otherwise(F.col("met"))) \
         .withColumn("j", F.when(first, F.col("met")).otherwise(F.col("own")))

    def gathered(s):  # in order, so that a block looks alike in all its tiles
        return F.array_sort(F.collect_list(F.when((F.col("side") == s) & F.col("u").isNotNull(), F.struct("pos", "u"))))
    tiles = t.groupBy("pair", "i", "j", (F.col("b0") * F.col("b1")).alias("tiles")).agg(
        gathered(0).alias("p"), gathered(1).alias("g"))
    pair = tiles.schema["pair"].dataType.simpleString()
    best = tiles.mapInArrow(_tile_scores, f"pair {pair}, side int, block int, at int, best double, n bigint")
    best = best.groupBy("pair", "side", "block", "at").agg(F.max("best").alias("best"), F.max("n").alias("n"))
    sums = [F.sum(F.when(F.col("side") == s, F.col(c))).alias(f"{c}{s}") for s in (0, 1) for c in ("best", "n")]
    scored = best.groupBy("pair").agg(*sums)
    both = (F.coalesce("n0", F.lit(0)) > 0) & (F.coalesce("n1", F.lit(0)) > 0)
    p, r = [F.when(both, F.col(f"best{s}") / F.col(f"n{s}")).otherwise(F.lit(0.0)) for s in (0, 1)]
    scored = scored.select(F.col("pair").alias(pair_col), p.alias("bert_precision"), r.alias("bert_recall"))
    p, r = F.col("bert_precision"), F.col("bert_recall")
    return scored.withColumn("bert_f1", F.when(p + r != 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0)))


def latency_summary(df: DataFrame, latency_col: str = "latency", group_cols: list[str] | None = None) -> DataFrame:
    """N, sum, avg over max(1, n), min, max, each rounded to 4; 0.0 when
    there are no rows (a global summary of an empty table is one zero row)."""
    lat = F.col(latency_col).cast("double")
    aggs = [F.count(lat).alias("n"), F.sum(lat).alias("__s"), F.min(lat).alias("__mn"), F.max(lat).alias("__mx")]
    g = df.groupBy(*group_cols).agg(*aggs) if group_cols else df.agg(*aggs)
    s = F.coalesce(F.col("__s"), F.lit(0.0))
    return g.select(*(group_cols or []), F.col("n").cast("bigint").alias("n"),
                    F.round(s, 4).alias("total_latency"),
                    F.round(s / F.greatest(F.col("n"), F.lit(1)), 4).alias("avg_latency"),
                    F.round(F.coalesce(F.col("__mn"), F.lit(0.0)), 4).alias("min_latency"),
                    F.round(F.coalesce(F.col("__mx"), F.lit(0.0)), 4).alias("max_latency"))


def metric_summary(rows: DataFrame, group_cols: list[str], metrics: list[str]) -> DataFrame:
    """Mean of each metric per group (module, or module x
    variant), rounded to 4, with the row count."""
    return rows.groupBy(*group_cols).agg(F.count(F.lit(1)).alias("n"),
                                         *[F.round(F.avg(m), 4).alias(f"mean_{m}") for m in metrics])


def token_usage_summary(calls: DataFrame, group_cols: list[str] | None = None) -> DataFrame:
    """Totals and means of prompt/completion/total tokens per group."""
    tot = F.col("prompt_tokens") + F.col("completion_tokens")
    aggs = [F.count(F.lit(1)).alias("calls"),
            F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"),
            F.sum(tot).alias("total_tokens"), F.round(F.avg(tot), 4).alias("avg_total_tokens")]
    return calls.groupBy(*group_cols).agg(*aggs) if group_cols else calls.agg(*aggs)


def same_result(gold: DataFrame, pred: DataFrame, pairs: DataFrame, pair_col: str = "pair_id",
                as_set: bool = False) -> DataFrame:
    """Per pair, whether the two result sets are equal (multiset by
    default, ``as_set`` ignores duplicates).  Rows are compared on all
    columns.  Both directions in one aggregation: every (pair, row) gets a
    signed count (+1 gold, -1 prediction) -- multisets are equal when all
    counts are 0; sets when every row is on both sides.  One shuffle on
    (pair, row) with map-side partial sums, so a pair's rows are never
    collected together."""
    cols = gold.columns
    m = gold.select(*cols, F.lit(1).alias("__w")).unionByName(pred.select(*cols, F.lit(-1).alias("__w")))
    if as_set:
        g = m.groupBy(*cols).agg(F.max("__w").alias("__hi"), F.min("__w").alias("__lo"))
        bad = g.filter(~((F.col("__hi") == 1) & (F.col("__lo") == -1)))
    else:
        g = m.groupBy(*cols).agg(F.sum("__w").alias("__s"))
        bad = g.filter(F.col("__s") != 0)
    diff = bad.select(pair_col).distinct().withColumn("__diff", F.lit(True))
    return pairs.select(pair_col).distinct().join(diff, pair_col, "left") \
                .select(pair_col, F.col("__diff").isNull().alias("match"))


def execution_accuracy(matches: DataFrame) -> DataFrame:
    """Share of pairs whose result sets are equal."""
    return matches.agg(F.count(F.lit(1)).alias("n"),
                       F.round(F.avg(F.col("match").cast("double")), 6).alias("execution_accuracy"))


def throughput(df: DataFrame, ts_col: str, target: int | None = None,
               group_cols: list[str] | None = None) -> DataFrame:
    """Items per second between the first and last timestamp, and the
    remaining time to ``target`` items at that rate."""
    secs = F.timestamp_diff("MICROSECOND", F.min(ts_col), F.max(ts_col)) / 1e6
    aggs = [F.count(F.lit(1)).alias("items"), secs.alias("elapsed_sec")]
    g = df.groupBy(*group_cols).agg(*aggs) if group_cols else df.agg(*aggs)
    rate = F.when(F.col("elapsed_sec") > 0, F.col("items") / F.col("elapsed_sec")).otherwise(F.lit(0.0))
    g = g.withColumn("rate", F.round(rate, 6)).withColumn("elapsed_sec", F.round("elapsed_sec", 6))
    if target is not None:
        g = g.withColumn("eta_sec", F.when(F.col("rate") > 0,
                                           F.round((F.lit(target) - F.col("items")) / F.col("rate"), 6))
                         .otherwise(F.lit(0.0)))
    return g


def evaluate_predictions(df: DataFrame, raw_col: str = "raw_output", gold_col: str = "gold",
                         id_col: str = "id", dialect: str = "eval", stem: bool = True,
                         tokens: DataFrame | None = None) -> DataFrame:
    """I8: per row extraction (B11), exact match (B16), ROUGE-L (I7) and, with
    ``tokens`` (``id_col``, side, pos, embedding of each row's two texts), the
    greedy embedding score (C12; 0 where a side has no token).  The mean row is
    ``metric_summary`` of the result (see ``evaluation_means``)."""
    pred = extract_fenced(raw_col, dialect)
    out = df.select(id_col, pred.alias("pred"), F.col(gold_col).alias("gold"))
    r = rouge_l(F.col("pred"), F.col("gold"), stem)
    out = out.withColumn("em", exact_match("pred", "gold")).withColumn("__r", r).select(
        id_col, "pred", "gold", "em", F.col("__r.p").alias("rougeL_p"), F.col("__r.r").alias("rougeL_r"),
        F.col("__r.f1").alias("rougeL_f1"))
    if tokens is None:
        return out
    match = greedy_match_score(tokens, pair_col=id_col)
    return out.join(match, id_col, "left").fillna(0.0, [c for c in match.columns if c != id_col])


def evaluation_means(rows: DataFrame) -> DataFrame:
    """The mean row of an evaluation: row count and mean of each score."""
    scores = [c for c, kind in rows.dtypes if kind == "double"]
    return metric_summary(rows.withColumn("__all", F.lit(0)), ["__all"], scores).drop("__all")
