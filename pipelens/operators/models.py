"""Models behind one interface: fit(df, label) and predict(df), which adds `prediction`. Some are plain SQL expressions."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Model:
    def fit(self, df: DataFrame, label: str):
        return self

    def predict(self, df: DataFrame) -> DataFrame:
        raise NotImplementedError


def make(factory) -> Model:
    return factory() if callable(factory) and not isinstance(factory, Model) else factory


class Dummy(Model):
    """The most frequent label (ties: the smallest), or a constant."""

    def __init__(self, constant=None):
        self.constant = constant

    def fit(self, df, label):
        self._value = self.constant if self.constant is not None else df.agg(F.mode(label, True)).first()[0]
        return self

    def predict(self, df):
        return df.withColumn("prediction", F.lit(self._value).cast("double"))


class Stump(Model):
    """1 where feature number `at` exceeds a threshold: a given one, or the middle between the classes' means."""

    def __init__(self, at: int = 0, threshold: float | None = None):
        self.at, self.threshold = at, threshold

    def _value_of(self):
        return vector_to_array(F.col("features"))[self.at]

    def fit(self, df, label):
        r = df.agg(F.avg(F.when(F.col(label) == 1, self._value_of())).alias("a"), F.avg(F.when(F.col(label) == 0, self._value_of())).alias("b")).first()
        a, b = r["a"] or 0.0, r["b"] or 0.0
        self._cut, self._up = (self.threshold if self.threshold is not None else (a + b) / 2), a >= b
        return self

    def predict(self, df):
        v = self._value_of()
        hit = v > self._cut if self._up else v < self._cut
        return df.withColumn("prediction", F.coalesce(hit & ~F.isnan(v), F.lit(False)).cast("double"))


class NearestCentroid(Model):
    """The class whose mean vector is nearest (ties: the smaller label)."""

    def fit(self, df, label):
        parts = df.select(label, F.posexplode(vector_to_array("features"))).groupBy(label, "pos").agg(F.avg("col").alias("m")).collect()
        centers: dict = {}
        for r in parts:
            centers.setdefault(r[label], {})[r["pos"]] = r["m"]
        self._centers = {k: [v[i] for i in sorted(v)] for k, v in sorted(centers.items())}
        return self

    def predict(self, df):
        a = vector_to_array("features")
        gaps = [F.struct(F.aggregate(F.zip_with(a, F.lit(c), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x).alias("d"), F.lit(float(k)).alias("k")) for k, c in self._centers.items()]
        return df.withColumn("prediction", F.array_min(F.array(*gaps))["k"])


class SparkModel(Model):
    """Any pyspark.ml estimator, by a factory that takes featuresCol and labelCol."""

    def __init__(self, factory, **options):
        self.factory, self.options = factory, options

    def fit(self, df, label):
        self._model = self.factory(featuresCol="features", labelCol="_y", **self.options).fit(df.where(F.col(label).isNotNull()).withColumn("_y", F.col(label).cast("double")))
        return self

    def predict(self, df):
        out = self._model.transform(df)
        return out.drop("rawPrediction", "probability")


def decision_tree(max_depth: int = 10, **o):
    from pyspark.ml.classification import DecisionTreeClassifier

    return SparkModel(DecisionTreeClassifier, maxDepth=max_depth, seed=1, **o)


def logistic_regression(c: float = 1.0, rows: int | None = None, **o):
    """regParam = 1 / (c * rows); without the number of rows, no regularisation."""
    from pyspark.ml.classification import LogisticRegression

    return SparkModel(LogisticRegression, regParam=1 / (c * rows) if rows else 0.0, **o)


def sgd(loss: str = "log_loss", max_iter: int = 30, **o):
    from pyspark.ml.classification import LinearSVC, LogisticRegression

    return SparkModel(LogisticRegression if loss == "log_loss" else LinearSVC, maxIter=max_iter, **o)


def svc(**o):
    """Linear: Spark has no kernels."""
    from pyspark.ml.classification import LinearSVC

    return SparkModel(LinearSVC, **o)


def boosted_trees(max_iter: int = 20, **o):
    from pyspark.ml.classification import GBTClassifier

    return SparkModel(GBTClassifier, maxIter=max_iter, seed=1, **o)


def neural_network(layers: list[int], **o):
    from pyspark.ml.classification import MultilayerPerceptronClassifier

    return SparkModel(MultilayerPerceptronClassifier, layers=layers, seed=1, **o)


def proxy():
    return sgd("log_loss", 30)


class GridSearch(Model):
    """Cross-validated choice of parameters; candidates run in parallel."""

    def __init__(self, factory, grid: dict[str, list], folds: int = 3):
        self.factory, self.grid, self.folds = factory, grid, folds

    def fit(self, df, label):
        from pyspark.ml.evaluation import MulticlassClassificationEvaluator
        from pyspark.ml.tuning import CrossValidator, ParamGridBuilder

        est = self.factory(featuresCol="features", labelCol="_y")
        grid = ParamGridBuilder()
        for k, v in self.grid.items():
            grid = grid.addGrid(est.getParam(k), v)
        cv = CrossValidator(estimator=est, estimatorParamMaps=grid.build(), evaluator=MulticlassClassificationEvaluator(labelCol="_y", metricName="accuracy"), numFolds=self.folds, parallelism=4, seed=1)
        self._model = cv.fit(df.withColumn("_y", F.col(label).cast("double"))).bestModel
        return self

    def predict(self, df):
        return self._model.transform(df).drop("rawPrediction", "probability")


class RetrievalVote(Model):
    """Stands in for a language model that reads retrieved texts: the majority label of what was retrieved (ties: the
    smaller). `answer` may be any function of (question column, array of contexts, array of labels)."""

    def __init__(self, answer=None):
        self.answer = answer

    def respond(self, questions: DataFrame, retrieved: DataFrame, corpus: DataFrame, label: str, text: str = "texts") -> DataFrame:
        """questions: _rid; retrieved: query, doc, rank; corpus: _rid, texts, label."""
        found = retrieved.join(corpus.select(F.col("_rid").alias("doc"), label, text), "doc")
        per = found.groupBy("query").agg(F.mode(label, True).alias("prediction"), F.sort_array(F.collect_list(F.struct("rank", text, label))).alias("context"))
        out = questions.join(per, questions["_rid"] == per["query"], "left")
        return out.withColumn("prediction", self.answer(F.col("context"))) if self.answer else out
