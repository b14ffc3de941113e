"""KNN Shapley values without rows for pairs: against the SQL, with ties and with rows that lack something."""

import random

import duckdb
import pytest

from pipelens import catalogue
from pipelens.operators import diagnostics
from pipelens.sources.readers import RID


def rows_of(kind):
    rng = random.Random(kind)
    rows = [[i, [float(rng.randrange(3)) for _ in range(4)], rng.randrange(3)] for i in range(260)]
    if kind == "lacking":
        for i in (3, 50, 77):
            rows[i][1] = rows[i][1][:2]
        rows[100][1][1] = None
        rows[9][1] = rows[120][1] = None
        rows[20][2] = rows[200][2] = None
    return rows


@pytest.mark.parametrize("kind", ["ties", "lacking"])
def test_values_are_those_of_the_sql(spark, tmp_path, kind):
    path = f"{tmp_path}/embeddings.parquet"
    spark.createDataFrame(rows_of(kind), "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(path)
    got = {r["train"]: r["shapley"] for r in catalogue.QUERIES["knn_shapley_values"](spark, str(tmp_path)).collect()}
    db = duckdb.connect()
    db.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{path}/*.parquet'")
    want = dict(db.execute(catalogue.ORACLE["knn_shapley_values"]).fetchall())
    assert set(got) == set(want) and len(got) == 254
    assert {k for k, v in got.items() if v is None} == {k for k, v in want.items() if v is None}
    assert all(v is None or v == pytest.approx(want[k], abs=2e-6) for k, v in got.items())


def test_no_row_for_a_pair_and_small_tiles(spark, monkeypatch):
    df = spark.createDataFrame(rows_of("ties"), f"{RID} long, embedding array<double>, label int")
    sides = df.where(f"{RID} % 5 <> 0"), df.where(f"{RID} % 5 = 0")
    made = diagnostics.knn_shapley(*sides, k=3)
    assert "Join" not in made._jdf.queryExecution().optimizedPlan().toString()
    whole = {r["train"]: r["shapley"] for r in made.collect()}
    sums = dict.fromkeys(whole, 0.0)
    train, test = ([tuple(r) for r in s.select(RID, "embedding", "label").collect()] for s in sides)
    for _, v, y in test:
        near = sorted(train, key=lambda r: (sum((a - b) ** 2 for a, b in zip(r[1], v, strict=True)) ** 0.5, r[0]))
        hit, worth = [int(r[2] == y) for r in near], 0.0
        for i in range(len(near), 0, -1):
            worth = hit[-1] / len(near) if i == len(near) else worth + (hit[i - 1] - hit[i]) * min(3, i) / i / 3
            sums[near[i - 1][0]] += worth / len(test)
    assert whole == pytest.approx(sums, abs=1e-12)
