"""What must hold however many rows, files or values there are: row ids, quantiles, hooks, repairs."""

import random

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from pipelens.functions import hooks
from pipelens.operators import cleaning, features
from pipelens.operators import relational as R
from pipelens.operators.quantiles import most_frequent, quantiles, summary
from pipelens.sources import readers
from pipelens.sources.readers import RID


def test_row_ids_of_many_files_differ(spark, tmp_path):
    folder = tmp_path / "a b%"
    folder.mkdir()
    for i in range(1500):
        pq.write_table(pa.table({"x": [2 * i, 2 * i + 1]}), folder / f"part-{i:05d}.parquet")
    df = readers.read_parquet(spark, str(folder))
    rows = df.select("x", RID).collect()
    assert len({r[RID] for r in rows}) == 3000
    assert sorted(rows, key=lambda r: r[RID]) == sorted(rows, key=lambda r: r["x"])  # files in the order of their names
    again = {r["x"]: r[RID] for r in readers.read_parquet(spark, str(folder)).repartition(3).collect()}
    assert again == {r["x"]: r[RID] for r in rows}
    one = readers.read_parquet(spark, str(folder / "part-00007.parquet"))
    assert sorted(r[RID] for r in one.collect()) == [0, 1] and one.columns == ["x", RID]


@pytest.mark.parametrize("kind", ["normal", "ties", "wide", "one", "integers"])
def test_quantiles_are_exact(spark, kind):
    rng = random.Random(kind)
    values = {
        "normal": [rng.gauss(0, 1) for _ in range(5000)], "ties": [float(rng.randrange(4)) for _ in range(3000)],
        "wide": [rng.choice([-1, 1]) * 10.0 ** rng.uniform(-30, 30) for _ in range(2000)], "one": [3.5], "integers": [float(rng.randrange(10**6)) for _ in range(4001)],
    }[kind]
    df = spark.createDataFrame([(v,) for v in values] + [(None,), (float("nan"),)], "v double")
    probs = [0.0, 0.1, 0.25, 0.5, 0.77, 1.0]
    assert quantiles(df, "v", probs) == pytest.approx(np.quantile(values, probs).tolist(), rel=1e-12)


def test_quantiles_of_nothing_and_most_frequent(spark):
    none = spark.createDataFrame([(None, None)], "v double, s string")
    assert quantiles(none, "v", [0.5]) is None and most_frequent(none, "s") is None and summary(none, "v", "median") is None
    some = spark.createDataFrame([("b",), ("a",), ("a",), ("b",), (None,), (None,), (None,)], "s string")
    assert most_frequent(some, "s") == "a"


def test_hooks_bear_nulls_and_ask_once(spark):
    df = spark.createDataFrame([("ab", 1), (None, 2), ("", 3), ("ab", 4)], "t string, i int").repartition(1)
    out = df.select("i", hooks.rewrite(lambda x: [f"{len(x)}:{v}" for v in x])(F.col("t")).alias("r"), hooks.embed(hooks.letter_pairs(4))(F.col("t")).alias("e")).orderBy("i").collect()
    assert [r["r"] for r in out] == ["2:ab", None, "2:", "2:ab"] and out[1]["e"] is None and sum(out[0]["e"]) == 1 and out[2]["e"] == [0.0] * 4
    asked = hooks.ask(df, "say {t} {i}!", lambda p: [x.upper() for x in p], lambda c: c).orderBy("i").collect()
    assert [r["answer"] for r in asked] == ["SAY AB 1!", "SAY  2!", "SAY  3!", "SAY AB 4!"]


def test_feature_union_weights(spark):
    df = spark.createDataFrame([(0, 1.0), (1, 3.0)], f"{RID} long, x double")
    u = features.FeatureUnion(features.StandardScaler(["x"]), features.FunctionTransformer(["x"], lambda c: c * 10), weights=[2.0, 0.5])
    assert [r["features"].toArray().tolist() for r in u.fit(df).apply(df).orderBy(RID).collect()] == [[-2.0, 5.0], [2.0, 15.0]]
    assert u.copy().spec() == u.spec() != features.FeatureUnion(*u.transformers).spec()


def test_repairs_of_categories_and_typos(spark):
    train = spark.createDataFrame([(i, "a" if i % 3 else "b", "not to be") for i in range(300)] + [(300, "z", "mot")], f"{RID} long, c string, t string")
    test = spark.createDataFrame([(0, "z", "mov vo re"), (1, "b", "mot to"), (2, None, None), (3, "new", "xyz not")], f"{RID} long, c string, t string")
    assert [r["c"] for r in cleaning.repair_rare(train, test, "c").orderBy(RID).collect()] == ["a", "b", None, "a"]
    fixed = [r["t"] for r in cleaning.repair_typos(train, test, "t", ("nbto", "mvrp")).orderBy(RID).collect()]
    assert fixed[1:] == ["mot to", None, "xyz not"]  # words of the training texts and unknown ones stay


def test_merges_keep_repeats(spark):
    a = spark.createDataFrame([("abc",), ("abc",), (None,)], "x string")
    b = spark.createDataFrame([("abd", 1), ("abd", 1), ("zzz", 2)], "y string, n int")
    assert [tuple(r) for r in R.fuzzy_merge(a, b, "x", "y", 0.6).collect()] == [("abc", "abd", 1)] * 4
    left = readers.inline(spark, [(5,), (6,)], "v long")
    assert sorted(tuple(r) for r in R.merge(left, spark.createDataFrame([(1, "k")], "at long, w string"), left_index=True, right_on=["at"]).select("v", "w").collect()) == [(6, "k")]
