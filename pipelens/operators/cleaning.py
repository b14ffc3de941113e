"""Cleaning methods: fitted on training rows, applied as filters or column expressions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pipelens.functions.text import spell_fix
from pipelens.operators.quantiles import quantiles, summary
from pipelens.sources.readers import RID

def outlier_bounds(df: DataFrame, column: str, rule: str = "sd") -> tuple[float, float]:
    """sd: mean plus and minus three population deviations; iqr: quartiles plus and minus k ranges (k = 1.5, or as in iqr:k)."""
    if rule == "sd":
        m, s = df.agg(F.avg(column), F.stddev_pop(column)).first()
        return (m or 0.0) - 3 * (s or 0.0), (m or 0.0) + 3 * (s or 0.0)
    k = float(rule.partition(":")[2] or 1.5)
    q = quantiles(df, column, [0.25, 0.75]) or [0.0, 0.0]
    return q[0] - k * (q[1] - q[0]), q[1] + k * (q[1] - q[0])


def is_outlier(c: Column, bounds: tuple[float, float]) -> Column:
    return F.coalesce((c < bounds[0]) | (c > bounds[1]), F.lit(False))


def repair_outliers(train: DataFrame, apply_to: DataFrame, column: str, rule: str = "sd", repair: str = "mean") -> DataFrame:
    """Bounds and the repair value come from train; the value is that of the rows within the bounds."""
    if rule == "if":
        return _isolation_repair(train, apply_to, column, repair)
    bounds = outlier_bounds(train, column, rule)
    value = summary(train.where(~is_outlier(F.col(column), bounds)), column, repair)
    return apply_to.withColumn(column, F.when(is_outlier(F.col(column), bounds), F.lit(value)).otherwise(F.col(column)))


class IsolationForest:
    """One-dimensional isolation forest in numpy, on a bounded sample of values; scoring is a column UDF."""

    def __init__(self, values, trees: int = 50, sample: int = 256, contamination: float = 0.01, seed: int = 1):
        import numpy as np

        rng = np.random.default_rng(seed)
        self.values, self.contamination, self.size = np.asarray(values, float), contamination, min(sample, len(values))
        self.cuts = []
        for _ in range(trees):
            x = np.sort(rng.choice(self.values, self.size, replace=False))
            self.cuts.append(self._grow(x, rng, 0, int(np.ceil(np.log2(max(2, self.size))))))
        self.limit = float(np.quantile(self.depth(self.values), contamination)) if len(self.values) else 0.0

    def _grow(self, x, rng, depth, most):
        if depth >= most or len(x) <= 1 or x[0] == x[-1]:
            n = len(x)
            return depth + (2 * (float(__import__("math").log(n - 1)) + 0.5772) - 2 * (n - 1) / n if n > 2 else (1.0 if n == 2 else 0.0))
        cut = float(rng.uniform(x[0], x[-1]))
        return (cut, self._grow(x[x <= cut], rng, depth + 1, most), self._grow(x[x > cut], rng, depth + 1, most))

    def depth(self, values):
        import numpy as np

        values = np.asarray(values, float)
        out = np.zeros(len(values))

        def walk(node, rows):
            if not len(rows):
                return
            if not isinstance(node, tuple):
                out[rows] += node
                return
            low = values[rows] <= node[0]
            walk(node[1], rows[low])
            walk(node[2], rows[~low])

        for t in self.cuts:
            walk(t, np.arange(len(values)))
        return out / max(1, len(self.cuts))


FOREST_SAMPLE = 10_000


def _isolation_repair(train: DataFrame, apply_to: DataFrame, column: str, repair: str) -> DataFrame:
    """The forest is fitted on FOREST_SAMPLE values chosen by hash; every row is scored, in Arrow batches."""

    sample = [r[0] for r in train.where(F.col(column).isNotNull()).orderBy(F.xxhash64(RID), RID).limit(FOREST_SAMPLE).select(F.col(column).cast("double")).collect()]
    forest = IsolationForest(sample) if sample else None

    @F.pandas_udf("boolean")
    def odd(x: pd.Series) -> pd.Series:
        return pd.Series(forest.depth(x.fillna(forest.values.mean())) < forest.limit).where(x.notna().to_numpy(), False)

    if forest is None:
        return apply_to
    value = summary(train.where(~odd(F.col(column))), column, repair)
    return apply_to.withColumn(column, F.when(odd(F.col(column)), F.lit(value)).otherwise(F.col(column)))


def repair_missing(train: DataFrame, apply_to: DataFrame, column: str, method: str) -> DataFrame:
    """mean, median, mode, dummy, or delete (training rows only)."""
    if method == "delete":
        return apply_to.where(F.col(column).isNotNull())
    value = "missing" if method == "dummy" else summary(train, column, method)
    return apply_to.withColumn(column, F.coalesce(F.col(column), F.lit(value)))


def repair_rare(train: DataFrame, apply_to: DataFrame, column: str, share: float = 0.01) -> DataFrame:
    """Categories that at most `share` of the training rows have, or none, become the most frequent one. By themselves
    in a forest over one-hot columns, the rarest categories are the ones that are isolated first."""
    counts = train.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("_value")).agg(F.count("*").alias("_n"))
    total, value = train.where(F.col(column).isNotNull()).count(), summary(train, column, "mode")
    common = counts.where(F.col("_n") > share * total).select("_value", F.lit(True).alias("_common"))
    out = apply_to.join(common, F.col(column) == F.col("_value"), "left")
    return out.withColumn(column, F.when(F.col(column).isNotNull() & F.col("_common").isNull(), F.lit(value)).otherwise(F.col(column))).drop("_value", "_common")


def repair_typos(train: DataFrame, apply_to: DataFrame, column: str, typing: tuple[str, str]) -> DataFrame:
    """Words that no training text has become the most frequent training word that they may be a mistyping of: typing
    has the right characters and, place by place, the wrong ones. Words of the training texts stay as they are."""
    words = lambda df: df.select(F.explode(F.split(F.col(column), " ")).alias("w")).where("w <> ''").groupBy("w").agg(F.count("*").alias("n"))
    plain = lambda c: F.translate(c, typing[1], typing[0])
    known = words(train)
    right = known.groupBy(plain("w").alias("form")).agg(F.max_by("w", F.struct("n", "w")).alias("right"))
    wrong = words(apply_to).join(known.select("w"), "w", "left_anti").select(F.col("w").alias("wrong"), plain("w").alias("form"))
    return spell_fix(apply_to, column, wrong.join(right, "form").select("wrong", "right"))


def confident_learning(df: DataFrame, label: str, make_model, folds: int = 5) -> DataFrame:
    """Rows whose given label is doubted: out-of-fold probabilities against each class's mean self-confidence.

    Folds are by hash of the row id; each fold's model is fitted on the others; one pass each scores the held-out fold.
    Returns (_rid, given, doubted)."""
    from pyspark.ml.functions import vector_to_array

    fold = F.pmod(F.xxhash64(F.col(RID)), F.lit(folds))
    parts = None
    for k in range(folds):
        m = make_model().fit(df.where(fold != k), label)
        scored = m._model.transform(df.where(fold == k)).select(RID, F.col(label).cast("int").alias("given"), vector_to_array("probability").alias("p"))
        parts = scored if parts is None else parts.unionAll(scored)
    bars = {r["given"]: r["t"] for r in parts.groupBy("given").agg(F.avg(F.element_at("p", F.col("given") + 1)).alias("t")).collect()}
    over = F.array(*(F.when(F.col("p")[k] >= t, F.struct(F.col("p")[k].alias("v"), F.lit(k).alias("k"))) for k, t in sorted(bars.items())))
    best = F.array_max(F.filter(over, lambda x: x.isNotNull()))["k"]
    return parts.select(RID, "given", F.coalesce(best != F.col("given"), F.lit(False)).alias("doubted"))
