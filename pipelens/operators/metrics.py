"""Scores as aggregations: one pass whatever the number of groups or variants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def accuracy(label: str = "label", prediction: str = "prediction") -> Column:
    return F.avg(F.col(label).eqNullSafe(F.col(prediction)).cast("double"))


def rate(label: str, prediction: str, of: int, said: int) -> Column:
    """The share of rows with label `of` that are predicted as `said`; NULL without such rows."""
    return F.avg(F.when(F.col(label) == of, (F.col(prediction) == said).cast("double")))


METRICS = {
    "accuracy": accuracy,
    "false_negative_rate": lambda y="label", p="prediction": rate(y, p, 1, 0),
    "false_positive_rate": lambda y="label", p="prediction": rate(y, p, 0, 1),
    "true_positive_rate": lambda y="label", p="prediction": rate(y, p, 1, 1),
    "selection_rate": lambda y="label", p="prediction": F.avg((F.col(p) == 1).cast("double")),
}


def metric_frame(df: DataFrame, metric: str, sensitive: str, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """(group_name, value): the metric by group, and `overall`."""
    m = METRICS[metric](label, prediction).alias("value")
    by = df.groupBy(F.coalesce(F.col(sensitive).cast("string"), F.lit("nan")).alias("group_name")).agg(m)
    return by.unionAll(df.agg(m).select(F.lit("overall").alias("group_name"), "value"))


def equalized_odds_difference(df: DataFrame, sensitive: str, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """The larger of the gaps in true and false positive rates between groups."""
    by = df.groupBy(sensitive).agg(METRICS["true_positive_rate"](label, prediction).alias("t"), METRICS["false_positive_rate"](label, prediction).alias("f"))
    return by.agg(F.greatest(F.max("t") - F.min("t"), F.max("f") - F.min("f")).alias("value"))


def relative_change(old: Column, new: Column) -> Column:
    return F.when(old == 0, 0.0).otherwise(new / old)
