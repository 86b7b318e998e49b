"""Partitions whose number grows with the files read."""

from pyspark.sql import functions as F

from quillon.operators import relational
from quillon.plans import registry

SF = "/root/testdata/sf0.001"


def test_spread(spark, monkeypatch):
    items = registry.table(spark, SF, "lineitem")
    assert relational.spread(items, "l_orderkey") is items
    want = registry.queries()["brand_revenue"](spark, SF)
    assert "REPARTITION_BY_NUM" not in want._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(relational, "SPREAD_FROM", 1)
    for size, least in ((1 << 40, 8), (4096, 20)):
        monkeypatch.setattr(relational, "SPREAD_BYTES", size)
        out = relational.spread(items, "l_orderkey")
        assert out.rdd.getNumPartitions() >= least
        assert out.count() == items.count()
        places = out.withColumn("at", F.spark_partition_id()).select("l_orderkey", "at").distinct()
        assert places.count() == places.select("l_orderkey").distinct().count()
        got = registry.queries()["brand_revenue"](spark, SF)
        assert "REPARTITION_BY_NUM" in got._jdf.queryExecution().executedPlan().toString()
        assert sorted(got.collect()) == sorted(want.collect())
