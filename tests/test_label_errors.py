"""The registered label-error query looks at all rows: against brute force."""

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from pipelens import catalogue
from pipelens.analyses import shadow
from pipelens.operators import models
from pipelens.plans.executor import Executor


def test_label_errors_report_looks_at_all_rows(spark, sf, tmp_path):
    spark.read.parquet(f"{sf}/orders.parquet").orderBy("o_orderkey").limit(160).write.parquet(f"{tmp_path}/orders.parquet")
    spark.read.parquet(f"{sf}/customer.parquet").write.parquet(f"{tmp_path}/customer.parquet")
    s = shadow._sides(catalogue.plan_of(spark, str(tmp_path)), Executor())
    y = s["label"]
    train, test = ([(r["_rid"], r[y], r["x"]) for r in df.select("_rid", y, vector_to_array("features").alias("x")).collect()] for df in (s["train_x"], s["test_x"]))
    value = dict.fromkeys((r for r, _, _ in train), 0.0)
    for _, label, x in test:
        near = sorted(train, key=lambda r: (sum((a - b) ** 2 for a, b in zip(r[2], x, strict=True)) ** 0.5, r[0]))
        hit, worth = [int(r[1] == label) for r in near], 0.0
        for i in range(len(near), 0, -1):
            worth = hit[-1] / len(near) if i == len(near) else worth + (hit[i - 1] - hit[i]) / i
            value[near[i - 1][0]] += worth / len(test)
    worst = sorted(value, key=lambda r: (round(value[r], 12), r))[:20]
    fixed = s["train_x"].withColumn(y, F.when(F.col("_rid").isin(worst), 1 - F.col(y)).otherwise(F.col(y)))
    after = shadow._accuracy(models.make(s["factory"]).fit(fixed, y).predict(s["test_x"]), y)
    got = catalogue.QUERIES["label_errors_report"](spark, str(tmp_path)).first()
    assert len(train) > 60 and got["flipped"] == 20
    assert got["before"] == shadow._accuracy(s["predicted"], y) and got["after"] == after
