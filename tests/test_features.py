"""Feature, metric, model, corruption and cleaning operators: the small known answers."""

import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from pipelens.operators import cleaning, corruption, metrics, models
from pipelens.operators import features as X
from pipelens.sources.readers import RID, inline, series


def col(df, c):
    return [r[0] for r in df.orderBy(RID).select(c).collect()]


@pytest.fixture
def fit(spark):
    return inline(spark, [(1,), (2,), (10,), (5,)], "A long")


@pytest.fixture
def new(spark):
    return inline(spark, [(1,), (2,), (10,), (1,)], "A long")


def test_scalers_and_bins(fit, new):
    assert col(X.StandardScaler(["A"]).fit(fit).apply(new), "A") == pytest.approx([-1, -0.714286, 1.571429, -1], abs=1e-5)
    assert col(X.RobustScaler(["A"]).fit(fit).apply(new), "A") == pytest.approx([-0.555556, -0.333333, 1.444444, -0.555556], abs=1e-5)
    assert col(X.KBinsDiscretizer(["A"], 3).fit(fit).apply(new), "A") == [0, 0, 2, 0]
    assert set(col(X.KBinsDiscretizer(["A"], 2, "kmeans").fit(fit).apply(new), "A")) == {0, 1}
    assert col(X.StandardScaler(["A"]).fit(fit.withColumn("A", F.lit(4))).apply(new.withColumn("A", F.lit(4))), "A") == [0.0] * 4


def test_imputers_and_encoders(spark):
    a = series(spark, ["cat_a", None, "cat_a", "cat_c"], "string", "A")
    b = series(spark, ["cat_a", None, "cat_a", "cat_d"], "string", "A")
    assert col(X.SimpleImputer(["A"], "most_frequent").fit(a).apply(b), "A") == ["cat_a", "cat_a", "cat_a", "cat_d"]
    assert col(X.SimpleImputer(["A"], "constant").fit(a).apply(b), "A")[1] == "missing_value"
    enc = X.OneHotEncoder(["A"]).fit(a)
    assert enc.outputs == ["A=cat_a", "A=cat_c", "A=nan"]
    assert [sum(r) for r in enc.apply(b).orderBy(RID).select(*[f"`{c}`" for c in enc.outputs]).collect()] == [1, 1, 1, 0]


def test_union_pca_svd_and_text(spark):
    m = inline(spark, [(1, "cat_a"), (2, "cat_b"), (10, "cat_a"), (5, "cat_c")], "A long, B string")
    ct = X.ColumnTransformer(X.StandardScaler(["A"]), X.OneHotEncoder(["B"]), X.Passthrough(["A"])).fit(m)
    out = ct.apply(m)
    v = col(out, vector_to_array("features"))
    assert out.columns == ["A", "B", RID, "features"] and len(v[0]) == 5 and v[2][4] == 10.0 and v[0][0] == pytest.approx(-1.0, abs=1e-6)
    assert len(col(X.PCATransformer(["A"], 1).fit(m).apply(m), vector_to_array("pca"))[0]) == 1
    assert len(col(X.TruncatedSVD(["A"], 1).fit(m).apply(m), vector_to_array("svd"))[0]) == 1
    t = series(spark, ["a dog sees a dog", "the cat", None], "string", "s")
    cv = X.CountVectorizer(["s"]).fit(t)
    assert cv._vocabulary == ["cat", "dog", "sees", "the"]
    w = X.TfidfTransformer(["counts"]).fit(cv.apply(t)).apply(cv.apply(t))
    assert sum(x * x for x in col(w, vector_to_array("counts"))[0]) == pytest.approx(1)
    assert X.HashingVectorizer(["s"], 16).apply(t).count() == 3 and X.Word2VecTransformer(["s"], 3).fit(t).apply(t).count() == 3
    p = X.Pipeline(X.SimpleImputer(["A"]), X.StandardScaler(["A"])).fit(m)
    assert col(p.apply(m), "A")[0] == pytest.approx(-1.0, abs=1e-6)


def test_metrics(spark):
    p = inline(spark, [(1, 1, "a"), (0, 0, "a"), (1, 0, "b"), (1, 1, "a")], "prediction int, label int, g string")
    assert p.agg(metrics.accuracy()).first()[0] == 0.75
    assert {r[0]: r[1] for r in metrics.metric_frame(p, "false_negative_rate", "g").collect()} == {"a": 0.0, "b": None, "overall": 0.0}
    assert metrics.equalized_odds_difference(p, "g").first()[0] == 1.0


@pytest.mark.parametrize("make", [models.Dummy, lambda: models.Stump(0), models.NearestCentroid, models.decision_tree, models.logistic_regression, models.svc, lambda: models.boosted_trees(2), lambda: models.neural_network([1, 3, 2])])
def test_models_tell_two_lumps_apart(spark, make):
    df = inline(spark, [(float(i), int(i >= 10)) for i in range(20)], "x double, label int")
    df = X.ColumnTransformer(X.StandardScaler(["x"])).fit(df).apply(df)
    out = models.make(make).fit(df, "label").predict(df)
    assert out.agg(metrics.accuracy()).first()[0] >= (0.5 if make is models.Dummy else 0.85)


def test_grid_search_and_confident_learning(spark):
    from pyspark.ml.classification import LogisticRegression

    df = inline(spark, [(float(i % 40), int((i % 40) >= 20) if i != 5 else 1) for i in range(120)], "x double, label int")
    df = X.ColumnTransformer(X.StandardScaler(["x"])).fit(df).apply(df)
    assert models.GridSearch(LogisticRegression, {"regParam": [0.0, 0.1]}, 2).fit(df, "label").predict(df).agg(metrics.accuracy()).first()[0] > 0.9
    assert 5 in {r[0] for r in cleaning.confident_learning(df, "label", models.proxy).where("doubted").select(RID).collect()}


def test_corruptions(spark):
    df = inline(spark, [(float(i), "abc"[i % 3]) for i in range(100)], "x double, c string")
    for kind in ("scaling", "missing_values", "gaussian_noise"):
        assert corruption.corrupt(df, "x", kind, 0.0).select("x").exceptAll(df.select("x")).count() == 0
        bad = corruption.corrupt(df, "x", kind, 0.5)
        assert bad.join(df.select(RID, F.col("x").alias("y")), RID).where("not (x <=> y)").count() in (49, 50)
    assert col(corruption.corrupt(df, "c", "categorical_shift", 1.0), "c") == [{"a": "b", "b": "c", "c": "a"}[x] for x in col(df, "c")]
    p = corruption.permute(df, "x", 3)
    assert sorted(col(p, "x")) == sorted(col(df, "x")) and col(p, "x") != col(df, "x")
    assert corruption.corrupt(df.withColumn("c", F.lit("nothing to be told")), "c", "typos", 1.0).where("c = 'nothing to be told'").count() == 0


def test_cleaning(spark):
    df = inline(spark, [(float(i % 10),) for i in range(200)] + [(1000.0,), (None,)], "x double")
    for rule in ("sd", "iqr", "if"):
        fixed = col(cleaning.repair_outliers(df, df, "x", rule, "mean"), "x")
        assert fixed[200] < 100 and fixed[201] is None
    assert col(cleaning.repair_missing(df, df, "x", "median"), "x")[201] == 5.0
    assert cleaning.repair_missing(df, df, "x", "delete").count() == 201
