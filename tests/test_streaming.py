from pyspark.sql import functions as F

from pipelens.operators import cleaning
from pipelens.operators import features as X
from pipelens.operators import models
from pipelens.plans.session import Session
from pipelens.sources.readers import read_parquet
from pipelens.streaming import monitor


def test_stream_scores_equal_batch_scores(spark, sf, tmp_path):
    s = Session(spark)
    f = s.read_parquet(f"{sf}/orders.parquet", key="o_orderkey")
    f = f.assign(label=(f["o_totalprice"] > 100000).map(lambda c: c.cast("int"), "int"))
    train, test = f.train_test_split(0.25, seed=1)
    train.fit(X.ColumnTransformer(X.StandardScaler(["o_totalprice"])), lambda: models.Stump(0), "label").score(test)
    score = monitor.scorer(s.plan)
    batch = read_parquet(spark, f"{sf}/orders.parquet", "o_orderkey").withColumn("label", (F.col("o_totalprice") > 100000).cast("int")).withColumn("ts", F.col("o_orderdate").cast("timestamp"))
    batch.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    q = monitor.windowed_scores(score(stream), "ts", "365 days", "1 day").writeStream.format("memory").queryName("scores").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    want = {r["start"]: (round(r["score"], 9), r["n"]) for r in monitor.windowed_scores(score(batch), "ts", "365 days", "1 day").collect()}
    got = {r["start"]: (round(r["score"], 9), r["n"]) for r in spark.table("scores").collect()}
    assert got == want and sum(n for _, n in got.values()) == batch.count()
    bounds = cleaning.outlier_bounds(batch, "o_totalprice", "iqr")
    assert monitor.windowed_profile(batch, "ts", "o_totalprice", bounds).agg(F.sum("n")).first()[0] == batch.count()
