"""Scoring streams with what a batch run has fitted, and watching scores and inputs by event-time window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pipelens.operators import metrics
from pipelens.plans.executor import Executor
from pipelens.plans.plan import Op, Plan


def scorer(plan: Plan, executor: Executor | None = None):
    """A function of a frame or stream with the test side's columns: features and predictions by the fitted plan. All
    of it is row-wise, so it runs in micro-batches as it does in batch."""
    ex, predict = executor or Executor(), plan.of(Op.PREDICT)[0]
    model = ex.value(plan, predict.parents[0])
    made = ex.value(plan, plan.nodes[predict.parents[1]].parents[0])
    return lambda df: model.predict(made.apply(df))


def windowed_scores(predicted: DataFrame, time: str, window: str = "10 minutes", late: str = "30 minutes", label: str = "label", metric: str = "accuracy") -> DataFrame:
    """The score by window; rows later than `late` are left out, and windows are emitted once they are complete."""
    by = predicted.withWatermark(time, late).groupBy(F.window(time, window))
    return by.agg(metrics.METRICS[metric](label).alias("score"), F.count("*").alias("n")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "score", "n")


def windowed_profile(stream: DataFrame, time: str, column: str, bounds: tuple[float, float], window: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Shares of missing values and of values outside bounds learned in batch, by window."""
    c = F.col(column)
    by = stream.withWatermark(time, late).groupBy(F.window(time, window))
    out = by.agg(F.avg(c.isNull().cast("double")).alias("missing"), F.avg(((c < bounds[0]) | (c > bounds[1])).cast("double")).alias("outliers"), F.count("*").alias("n"))
    return out.select(F.col("window.start").alias("start"), "missing", "outliers", "n")
