"""A key holding a third of all rows: AQE splits the skewed join, results stay exact."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from orderscope.operators import model as M
from orderscope.testing.plans import plan_text

SKEW_CONF = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1024",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16384",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
}


@pytest.fixture()
def skew_conf(spark):
    old = {k: spark.conf.get(k, None) for k in SKEW_CONF}
    for k, v in SKEW_CONF.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        if v is None:
            spark.conf.unset(k)
        else:
            spark.conf.set(k, v)


def test_hot_product_is_split_and_counts_are_exact(spark, skew_conf):
    n = 90_000
    ids = spark.range(n)
    items = ids.select(
        F.floor(F.col("id") / 3).cast("bigint").alias("order_id"),
        (F.col("id") % 3 + 1).cast("int").alias("order_item_id"),
        F.when(F.col("id") % 3 == 0, F.lit("hot"))
        .otherwise(F.concat(F.lit("p"), (F.col("id") % 500).cast("string")))
        .alias("product_id"),
        F.lit("s1").alias("seller_id"),
        F.lit("1.00").cast("decimal(12,2)").alias("price"),
        F.lit("0.10").cast("decimal(12,2)").alias("freight_value"),
    )
    products = spark.range(500).select(
        F.concat(F.lit("p"), F.col("id").cast("string")).alias("product_id"),
        F.lit("casa").alias("product_category_name"),
    ).unionByName(spark.createDataFrame([("hot", "beleza")], "product_id string, product_category_name string"))
    translation = spark.createDataFrame(
        [("beleza", "health_beauty"), ("casa", "housewares")],
        "product_category_name string, product_category_name_english string",
    )
    delivered = spark.range(n // 3).select(
        F.col("id").alias("order_id"),
        F.lit(0).alias("is_late"),
        F.lit(5).alias("review_score"),
        F.lit(0).alias("low_review"),
    )
    oc = M.order_category(items, products, translation, delivered)
    got = {r["category"]: (r["orders"], r["gmv"]) for r in oc.groupBy("category").agg(
        F.count(F.lit(1)).alias("orders"), F.sum("merchandise_gmv_brl").alias("gmv")
    ).collect()}
    assert got["health_beauty"][0] == n // 3 and str(got["health_beauty"][1]) == f"{n // 3}.00"
    assert got["housewares"][0] == n // 3 and str(got["housewares"][1]) == f"{2 * n // 3}.00"
    oc.collect()
    text = plan_text(oc, "simple")  # the final adaptive plan marks split joins
    assert "SortMergeJoin(skew=true)" in text and "AQEShuffleRead skewed" in text
