"""Plan-level guarantees for every registered query (what `explain` shows)."""

from __future__ import annotations

import re

import pytest

import __spark_entry__ as entry
from builders import SF_SMALL
from orderscope.plans.commerce import MATERIALIZED, OPERATOR_NAMES, CommerceModel
from orderscope.testing.adapter import adapt_tables
from orderscope.testing.plans import plan_text, summarize


@pytest.fixture(scope="module")
def model(spark):
    return entry.model_for(spark, SF_SMALL, MATERIALIZED)


@pytest.fixture(scope="module")
def landed(spark, tmp_path_factory):
    """The model over landed files, as in production, with its stored tables."""
    root = tmp_path_factory.mktemp("landed")
    tables = {}
    for name, df in adapt_tables(spark, SF_SMALL).items():
        df.write.parquet(f"{root}/{name}")
        tables[name] = spark.read.parquet(f"{root}/{name}")
    return CommerceModel(tables, entry.TEST_PARAMS).materialize()


@pytest.mark.parametrize("name", OPERATOR_NAMES)
def test_no_cartesian_no_python_in_plan(model, name):
    text = plan_text(getattr(model, name)())
    assert summarize(text).forbidden == []


def test_month_window_prunes_partitions(model):
    text = plan_text(model.monthly_report())
    pruned = re.findall(r"PartitionFilters: \[(.*)\]", text)
    assert any("purchase_month" in p and "1997-01" in p for p in pruned)


def test_reports_read_only_needed_fact_columns(model):
    # 7 metric inputs + the delivered-base filter columns, out of the fact's 28 columns
    text = plan_text(model.kpi_summary())
    schemas = re.findall(r"ReadSchema: struct<(.*)>", text)
    assert schemas and all(len(re.findall(r"(\w+):", s)) <= 9 for s in schemas)
    pushed = " ".join(re.findall(r"PushedFilters: \[(.*)\]", text))
    assert "EqualTo(order_status,delivered)" in pushed
    assert "IsNotNull(order_delivered_customer_date)" in pushed


def test_latest_review_is_an_aggregate_not_a_window(model):
    s = summarize(plan_text(model.latest_review()))
    assert s.windows == 0 and s.aggregates


def test_kpi_extended_reads_the_fact_once(model):
    s = summarize(plan_text(model.kpi_extended()))
    assert s.subqueries == 1  # the count of the orders table


def test_seller_benchmarks_share_one_subquery(model, spark):
    df = model.seller_performance()
    df.collect()
    text = plan_text(df)
    assert "ReusedSubquery" in text


NO_BROADCAST = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
}


@pytest.fixture()
def no_broadcast(spark):
    old = {k: spark.conf.get(k, None) for k in NO_BROADCAST}
    for k, v in NO_BROADCAST.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        if v is None:
            spark.conf.unset(k)
        else:
            spark.conf.set(k, v)


def test_full_scale_shuffle_budget(landed, no_broadcast):
    """Hash shuffles when no join side can be broadcast (the full-scale plan shape)."""
    model = landed

    def shuffles(df):
        summary = summarize(plan_text(df))
        assert summary.forbidden == []
        return summary.shuffles

    jobs = {}
    for i, name in enumerate(MATERIALIZED):
        before = {k: model.stored[k] for k in MATERIALIZED[:i]}
        jobs[name] = shuffles(getattr(CommerceModel(model.tables, model.params, before), name)())
    # items and payments are aggregated once and put into buckets of their order; the fact adds
    # orders, customers and reviews and one re-key to order_id, and attribution meets outcomes
    # in their buckets: what is left are items by product, pairs by (order, category) and by order
    assert jobs == {
        "order_seller_money": 1, "order_payment_money": 1, "product_category": 3, "order_fact": 4,
        "order_outcomes": 0, "order_category": 3, "order_seller": 2,
    }
    assert shuffles(model.payment_mix()) == 1
    assert shuffles(model.kpi_extended()) == 1
    assert shuffles(model.kpi_summary()) == 0
    assert shuffles(model.state_performance()) == 1
    assert shuffles(model.seller_performance()) <= 3
