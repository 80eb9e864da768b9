"""Global ranks and in-plan key assertions."""

from __future__ import annotations

import pytest
from builders import build_tables, customer, order
from orderscope.operators.model import unique_rows
from orderscope.operators.ranking import ranked
from orderscope.plans.commerce import CommerceModel
from orderscope.testing.plans import plan_text
from pyspark.sql import functions as F


def test_ranks_are_global_and_ties_are_split(spark):
    """Half of the rows share their first columns: several tasks rank them."""
    rows = [(i % 2 == 0, (i % 2) * (i % 5), f"s{i:05d}") for i in range(4_000)]
    df = spark.createDataFrame(rows, "flag boolean, n int, id string").repartition(4)
    out = ranked(df, [F.desc("flag"), F.desc("n"), F.asc("id")])
    assert out.columns == ["flag", "n", "id", "rank"]
    expected = sorted(rows, key=lambda r: (not r[0], -r[1], r[2]))
    got = sorted(out.collect(), key=lambda r: r["rank"])
    assert [r["rank"] for r in got] == list(range(1, 4_001))
    assert [tuple(r)[:3] for r in got] == expected
    first = df.repartitionByRange(8, F.desc("flag"), F.desc("n"), F.asc("id")).where("flag").withColumn("p", F.spark_partition_id())
    assert first.select("p").distinct().count() > 2
    assert ranked(df.where("false"), [F.asc("id")]).count() == 0


def test_rank_window_is_over_partitions_only(spark):
    df = spark.range(1_000).withColumn("k", F.col("id") % 3)
    text = plan_text(ranked(df, [F.desc("k"), F.asc("id")]))
    assert "windowspecdefinition(_part" in text and "windowspecdefinition(k" not in text


def test_unique_rows(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2), (None, 3), (None, 4)], "k string, v int")
    assert {tuple(r) for r in unique_rows(df, "k", "t").collect()} == {("a", 1), ("b", 2)}
    twice = df.union(spark.createDataFrame([("b", 5)], "k string, v int"))
    with pytest.raises(Exception, match="duplicate join key t.k=b"):
        unique_rows(twice, "k", "t").collect()
    with pytest.raises(Exception, match="duplicate join key t.k=b"):
        unique_rows(twice, "k", "t").count()  # no column is asked for


@pytest.mark.parametrize(
    "change,report,message",
    [
        ({"orders": [order("o1"), order("o1", customer="c_2")]}, "kpi_summary", "orders.order_id=o1"),
        ({"orders": [order("o1"), order("o2", customer="c_o1")], "customers": [customer("c_o1")]}, "delay_impact", "orders.customer_id=c_o1"),
        ({"customers": [customer("c_o1"), customer("c_o1")]}, "state_performance", "customers.customer_id=c_o1"),
        ({"sellers": [{"seller_id": "s1", "seller_state": "SP"}] * 2}, "seller_performance", "sellers.seller_id=s1"),
        ({"products": [{"product_id": "p1"}] * 2}, "category_performance", "products.product_id=p1"),
    ],
)
def test_lazy_reports_raise_on_duplicate_keys(spark, change, report, message):
    """Without materialize(): the joins of the report assert their keys themselves."""
    rows = {"orders": [order("o1")]} | change
    tables = build_tables(spark, **rows)
    if report == "kpi_summary":  # two rows of one order, each with a customer of its own
        tables["customers"] = build_tables(spark, customers=[customer("c_o1"), customer("c_2")], orders=[order("o1")])["customers"]
    with pytest.raises(Exception, match=f"duplicate join key {message}"):
        getattr(CommerceModel(tables), report)().collect()
