"""A join with a few groups leaves rows spread over the tasks."""

from pyspark.sql import functions as F

from pipelens.plans.executor import Executor
from pipelens.plans.session import Session


def test_join_with_few_groups_leaves_rows_spread(spark, sf):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        s = Session(spark)
        o = s.read_parquet(f"{sf}/orders.parquet", key="o_orderkey")
        c = s.read_parquet(f"{sf}/customer.parquet", key="c_custkey")
        o = o.merge(c, left_on="o_custkey", right_on="c_custkey")
        j = o.merge(o.groupby("o_orderstatus").agg(m=("o_totalprice", "mean")), on="o_orderstatus")
        kept = Executor().value(s.plan, j.node).persist()
        sizes = [r[0] for r in kept.groupBy(F.spark_partition_id()).count().select("count").collect()]
        assert sum(sizes) == spark.read.parquet(f"{sf}/orders.parquet").count() and max(sizes) < 0.4 * sum(sizes)
        kept.unpersist()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
