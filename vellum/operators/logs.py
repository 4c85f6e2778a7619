"""Training logs, schedules and trials."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def epoch_means(log: DataFrame, by: list[str], value: str) -> DataFrame:
    return log.groupBy(*by).agg(F.round(F.avg(value), 6).alias("mean"), F.count(F.lit(1)).alias("n"))


def pivoted(log: DataFrame, by: list[str], metric: str, value: str, metrics: list[str]) -> DataFrame:
    """One column a metric, named beforehand so that no pass is spent on finding them."""
    return log.groupBy(*by).agg(*[F.round(F.sum(F.when(F.col(metric) == m, F.col(value))), 6).alias(m) for m in metrics])


def early_stop(log: DataFrame, run: str, order: list[str], value: str, patience: int) -> DataFrame:
    """For each run, the step at which a value hasn't been below the best so far for ``patience`` steps, else its last; and the best."""
    w = Window.partitionBy(run).orderBy(*order)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    own = log.withColumn("step", F.row_number().over(w)).withColumn("best_", F.min(value).over(before))
    own = own.withColumn("gain_", F.when(F.col("best_").isNull() | (F.col(value) < F.col("best_")), F.col("step")))
    own = own.withColumn("since_", F.col("step") - F.last("gain_", ignorenulls=True).over(w))
    stops = own.groupBy(run).agg(F.min(F.when(F.col("since_") >= patience, F.col("step"))).alias("s_"), F.max("step").alias("n_"))
    stops = stops.select(run, F.coalesce("s_", "n_").alias("stop"))
    return own.join(stops, run).where(F.col("step") <= F.col("stop")).groupBy(run, "stop").agg(F.min(value).alias("best"))


def best_trial(trials: DataFrame, metric: str, columns: list[str], by: list[str]) -> DataFrame:
    """The trial with the smallest metric, ties by the columns."""
    top = trials.groupBy(*by).agg(F.min(F.struct(metric, *columns)).alias("t_"))
    return top.select(*by, "t_.*")


def on_plateau(log: DataFrame, run: str, order: list[str], value: str, base: float, factor: float = 0.5, patience: int = 3) -> DataFrame:
    """The learning rate after a run: cut whenever the value hasn't gone below its best for more than ``patience`` steps.

    A fold over a run's values in order; runs are what is distributed.
    """
    values = log.groupBy(run).agg(F.transform(F.array_sort(F.collect_list(F.struct(*order, F.col(value).alias("v_")))), lambda s: s["v_"]).alias("vs"))
    start = F.struct(F.lit(base).alias("lr"), F.lit(float("inf")).alias("best"), F.lit(0).alias("bad"))

    def step(s, v):
        better = v < s["best"]
        bad = F.when(better, 0).otherwise(s["bad"] + 1)
        cut = bad > patience
        return F.struct(F.when(cut, s["lr"] * factor).otherwise(s["lr"]).alias("lr"), F.least(s["best"], v).alias("best"), F.when(cut, 0).otherwise(bad).alias("bad"))

    return values.select(run, F.aggregate("vs", start, step)["lr"].alias("lr"))


def schedule_steps(samples, epochs, batch, accumulate):
    """Optimiser steps of a training."""
    return F.floor(samples * epochs / (batch * accumulate))


def padded_size(n, batch):
    """Samples of a dataset that is handed out in whole batches."""
    return F.ceil(n / batch) * batch
