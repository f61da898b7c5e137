"""Perplexity and metrics weighted by examples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def perplexity(
    losses: DataFrame, loss_col: str = "loss", seq_col: str = "seq_id", batch_size: int = 2, max_eval_steps: int = -1
) -> DataFrame:
    """One row: mean loss and its exponential.

    A positive ``max_eval_steps`` stops after that many batches and one more.
    """
    if max_eval_steps > 0:
        losses = losses.filter(F.floor(F.col(seq_col) / batch_size) <= max_eval_steps)
    mean = F.avg(loss_col)
    return losses.agg(mean.alias("loss"), F.exp(mean).alias("perplexity"))


def weighted_metric(clients: DataFrame, count_col: str = "num_examples", metric_col: str = "perplexity") -> DataFrame:
    """One row: the metric averaged over clients, weighted by their examples."""
    weight = F.col(count_col).cast("double")
    return clients.agg(F.try_divide(F.sum(weight * F.col(metric_col)), F.sum(weight)).alias(metric_col))


def weighted_vector_mean(df: DataFrame, key_col: str, vector_col: str, weight_col: str) -> DataFrame:
    """(key, vector): weighted mean of parameter vectors.

    Positions are summed before the shuffle, so a hot key costs one row per
    position and task.
    """
    weight = F.col(weight_col).cast("double")
    entries = df.select(key_col, weight.alias("_weight"), F.posexplode(vector_col).alias("_at", "_value"))
    means = entries.groupBy(key_col, "_at").agg(
        (F.sum(F.col("_weight") * F.col("_value").cast("double")) / F.sum("_weight")).alias("_mean")
    )
    ordered = F.array_sort(F.collect_list(F.struct("_at", "_mean")))
    return means.groupBy(key_col).agg(F.transform(ordered, lambda entry: entry["_mean"]).alias(vector_col))
