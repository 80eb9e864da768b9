"""What the stored tables move: one exchange for rows summed by order, buckets that grow in number."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from builders import build_tables, customer, item, order, payment, review
from orderscope.operators.model import unique_rows
from orderscope.plans import commerce
from orderscope.plans.commerce import MATERIALIZED, CommerceModel
from orderscope.testing.plans import plan_text, summarize


@pytest.fixture(scope="module")
def tables(spark):
    """An order with most of the items, items and payments of no order, an order without either."""
    items = [item("o1", n, product=f"p{n % 3}", seller=f"s{n % 4}", price="9999999999.99" if n % 2 else None) for n in range(1, 41)]
    items += [item("o2"), item("o2", 2, seller=None, product=None), item(None), item(None, 2, seller="s2")]
    built = build_tables(
        spark,
        orders=[order("o1"), order("o2", purchase="2018-03-01 10:00:00", delivered="2018-03-04 10:00:00"), order("o3")],
        customers=[customer("c_o1"), customer("c_o2", state="RJ"), customer("c_o3")],
        items=items,
        payments=[payment("o1", n) for n in range(1, 31)] + [payment("o2"), payment(None), payment(None, 2)],
        reviews=[review("r1", "o1", 1), review("r2", "o2", 5)],
        products=[{"product_id": f"p{n}", "product_category_name": "beleza" if n else None} for n in range(2)],
        sellers=[{"seller_id": "s1", "seller_state": "SP"}, {"seller_id": "s2", "seller_state": None}],
    )
    return {name: df.cache() for name, df in built.items()}


def rows(df):
    return sorted(map(repr, df.select(*sorted(df.columns)).collect()))


@pytest.mark.parametrize("heavy_rows", [1, 10])
def test_stored_tables_equal_the_lazy_ones(spark, tables, tmp_path, monkeypatch, heavy_rows):
    monkeypatch.setattr(commerce, "HEAVY_ROWS", heavy_rows)
    lazy = CommerceModel(tables)
    stored = lazy.materialize(str(tmp_path / "model"))
    assert set(stored.counted["order_items"].heavy) == {1: {"o1", "o2"}, 10: {"o1"}}[heavy_rows]
    for name in MATERIALIZED:
        assert rows(getattr(stored, name)()) == rows(getattr(lazy, name)()), name
    assert rows(stored.state_performance()) == rows(lazy.state_performance())


def test_most_heavy_keys_only(spark, monkeypatch):
    monkeypatch.setattr(commerce, "HEAVY_ROWS", 2)
    monkeypatch.setattr(commerce, "MOST_HEAVY", 1)
    df = spark.createDataFrame([("a",), ("a",), ("b",), ("b",), ("b",), ("c",), (None,), (None,), (None,), (None,)], "k string")
    assert commerce._count_rows(df, "k") == commerce.RowCounts(10, ("b",))


def test_buckets_grow_with_the_rows(spark, tables, tmp_path, monkeypatch):
    monkeypatch.setattr(commerce, "ROWS_PER_BUCKET", 4)
    model = CommerceModel(tables).materialize(str(tmp_path / "model"))
    assert model._buckets() == 11  # 44 items; the session has 8 shuffle partitions
    text = plan_text(model.payment_mix())
    assert "out of 11" in text
    assert summarize(plan_text(CommerceModel(tables, model.params, {
        k: model.stored[k] for k in ("order_seller_money", "order_payment_money")
    }, model.counted).order_fact())).shuffles <= 4


def test_rows_summed_by_order_move_once(spark, tables, tmp_path):
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}
    model = CommerceModel(tables).materialize(str(tmp_path / "model"))
    old = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        heavy = model.counted["order_items"].heavy
        few, _ = commerce._in_buckets(model.t("order_items"), commerce.model.order_seller_money, "order_id", heavy, 8)
        assert summarize(plan_text(few)).shuffles == 1
        pairs = model._written("order_category", model.order_category(), 8, str(tmp_path / "x"))
        assert summarize(plan_text(pairs)).shuffles == 2  # items to their category and to their order
    finally:
        for k, v in old.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def test_pairs_stay_where_small_sellers_come(spark, tables, tmp_path):
    """However large Spark thinks a join that makes the sellers is."""
    sellers = tables["sellers"].join(spark.range(200_000).select(F.col("id").cast("string").alias("seller_id")), "seller_id", "left")
    model = CommerceModel({**tables, "sellers": sellers}).materialize(str(tmp_path / "model"), ("order_seller_money", "order_outcomes"))
    text = plan_text(model._written("order_seller", model.order_seller(), 8, str(tmp_path / "y")))
    assert "BroadcastExchange" in text and summarize(text).shuffles <= 1


def test_unique_rows_move_before_they_are_sorted(spark, tmp_path):
    spark.range(100).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t")).withColumn("v", F.col("id").cast("string"))
    lines = plan_text(unique_rows(df, "id", "t"), "simple").splitlines()
    exchange = next(i for i, line in enumerate(lines) if "Exchange hashpartitioning" in line)
    assert not any("Aggregate" in line or "Sort" in line for line in lines[exchange:])  # nothing below it


def test_outcomes_follow_from_what_moves(spark, tables):
    fact = CommerceModel(tables).order_fact()
    again = commerce.model.outcome_columns(fact.drop(*commerce.model.OUTCOME_COLUMNS))
    assert again.columns == fact.columns and rows(again) == rows(fact)
