"""Hyper-parameter trial logs.

The trial log is data: one row per evaluation step of a trial.  Per-trial
aggregates are grouped by trial (partial aggregation), the best trial is a
``min_by`` and the top list an ``orderBy().limit()`` (TakeOrdered: each task
keeps ``n`` rows)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Search space of the LoRA trials and the effective batch.
LORA_RANKS = [8, 16, 32, 64]
BATCH_SIZES = [2, 4, 8]
EFFECTIVE_BATCH = 16


def derived_trial_columns(rank: Column, batch_size: Column) -> dict[str, Column]:
    """lora_alpha = 2 x rank, gradient_accumulation = 16 // batch,
    effective_batch = their product."""
    ga = F.floor(F.lit(EFFECTIVE_BATCH) / batch_size).cast("bigint")
    return {"lora_alpha": (rank * 2).cast("bigint"), "gradient_accumulation": ga,
            "effective_batch": (batch_size * ga).cast("bigint")}


def trial_losses(log: DataFrame, trial_col: str = "trial", step_col: str = "step",
                 loss_col: str = "eval_loss") -> DataFrame:
    """Per trial the best (min) and the last eval loss and the number
    of evaluations; a trial without any eval loss is ``failed``."""
    ev = F.col(loss_col)
    g = log.groupBy(trial_col).agg(
        F.count(ev).alias("n_evals"), F.min(ev).alias("best_loss"),
        F.max_by(ev, F.when(ev.isNotNull(), F.col(step_col))).alias("last_loss"))
    return g.withColumn("failed", F.col("n_evals") == 0)


def trial_state(losses: DataFrame, prune_ratio: float = 1.5) -> Column:
    """State of a trial: FAIL without evals; PRUNED when its last loss is
    above ``prune_ratio`` x its best; else COMPLETE."""
    return (F.when(F.col("failed"), "FAIL")
            .when(F.col("last_loss") > F.col("best_loss") * prune_ratio, "PRUNED").otherwise("COMPLETE"))


def trial_states(losses: DataFrame, prune_ratio: float = 1.5) -> DataFrame:
    """Number of finished (complete + pruned), pruned, complete and failed trials."""
    s = trial_state(losses, prune_ratio)
    return losses.agg(F.count_if(s != "FAIL").alias("finished"), F.count_if(s == "PRUNED").alias("pruned"),
                      F.count_if(s == "COMPLETE").alias("complete"), F.count_if(s == "FAIL").alias("failed"))


def top_trials(trials: DataFrame, n: int = 10, loss_col: str = "best_loss", trial_col: str = "trial") -> DataFrame:
    """the ``n`` trials with the lowest loss (ties by trial)."""
    return trials.filter(F.col(loss_col).isNotNull()).orderBy(loss_col, trial_col).limit(n)


def best_trial(trials: DataFrame, loss_col: str = "best_loss", trial_col: str = "trial") -> DataFrame:
    """the trial with the lowest loss and its parameters (ties by trial)."""
    cols = trials.columns
    best = trials.filter(F.col(loss_col).isNotNull()).agg(
        F.min_by(F.struct(*cols), F.struct(F.col(loss_col), F.col(trial_col))).alias("b"))
    return best.select("b.*")
